"""Byte-pair training on a table of strings.

Strings become fragments, fragments become a weighted table (one shuffle, counted before it).
If that table is small it is collected, at most ``local_limit`` rows, and merged with pair counts
kept up to date; else rounds on Spark read and rewrite only the words that their merges touch (``incremental``).
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.functions.columns import safe_fragments
from fragmill.operators import tokens as tk
from fragmill.plans.incremental import learn_incremental
from fragmill.plans.model import SPECIAL, FragmentTokenizer


def merges_wanted(vocab_size: int) -> int:
    n = vocab_size - 256 - len(SPECIAL)
    if n < 0:
        raise ValueError(f"vocab_size is at least {256 + len(SPECIAL)}")
    return n


def exploded_fragments(df: DataFrame, smiles: str = "smiles", *keys: str) -> DataFrame:
    """keys, pos, fragment of every string."""
    return df.select(*keys, F.posexplode(safe_fragments(smiles)).alias("pos", "fragment"))


def weighted_fragments(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """fragment, n: how often each fragment occurs.  Strings are counted first, so the kernel sees each once."""
    strings = df.groupBy(smiles).agg(F.count("*").alias("times"))
    parts = strings.select(F.explode(safe_fragments(smiles)).alias("fragment"), "times")
    return parts.groupBy("fragment").agg(F.sum("times").alias("n"))


def learn(counts: Iterable[tuple[str, int]], n_merges: int) -> list[tuple[int, int]]:
    """Merges of weighted texts.  Heap entries may be stale; those whose count has changed are dropped."""
    words = [text.encode().decode("latin-1") for text, _ in counts]
    weight = [n for _, n in counts]
    total: dict[str, int] = defaultdict(int)
    where: dict[str, set[int]] = defaultdict(set)

    def count(i: int, sign: int, touched: set[str]) -> None:
        w = words[i]
        for a, b in zip(w, w[1:]):
            total[a + b] += sign * weight[i]
            touched.add(a + b)
            if sign > 0:
                where[a + b].add(i)

    touched: set[str] = set()
    for i in range(len(words)):
        count(i, 1, touched)
    heap = [(-n, tk.token(p[0]), tk.token(p[1])) for p, n in total.items()]
    heapq.heapify(heap)
    merges: list[tuple[int, int]] = []
    while heap and len(merges) < n_merges:
        n, left, right = heapq.heappop(heap)
        pair = tk.symbol(left) + tk.symbol(right)
        if total.get(pair, 0) != -n or n == 0:
            continue
        new = tk.symbol(256 + len(merges))
        merges.append((left, right))
        touched = set()
        for i in where.pop(pair):
            if pair in words[i]:
                count(i, -1, touched)
                words[i] = words[i].replace(pair, new)
                count(i, 1, touched)
        for p in touched:
            if total[p] > 0:
                heapq.heappush(heap, (-total[p], tk.token(p[0]), tk.token(p[1])))
            else:
                del total[p]
    return merges


def learn_distributed(counts: DataFrame, n_merges: int, every: int = 20) -> list[tuple[int, int]]:
    """The same merges on Spark; counts(fragment, n).  Rounds read what their merges touch (plans.incremental)."""
    return learn_incremental(counts, n_merges, every)


class BpeTrainer:
    """fit(df) -> FragmentTokenizer, over the column ``smiles``."""

    def __init__(self, vocab_size: int, smiles: str = "smiles", local_limit: int = 200_000):
        self.n_merges, self.smiles, self.local_limit = merges_wanted(vocab_size), smiles, local_limit

    def fit(self, df: DataFrame) -> FragmentTokenizer:
        counts = weighted_fragments(df.where(F.col(self.smiles).isNotNull()), self.smiles)
        rows = counts.limit(self.local_limit + 1).collect()
        if len(rows) <= self.local_limit:
            return FragmentTokenizer(learn([(r["fragment"], r["n"]) for r in rows], self.n_merges))
        return FragmentTokenizer(learn_distributed(counts, self.n_merges))


def train_from_iterator(spark: SparkSession, items: Iterable[str], vocab_size: int) -> FragmentTokenizer:
    from fragmill.sources.tables import from_iterator

    return BpeTrainer(vocab_size).fit(from_iterator(spark, items))
