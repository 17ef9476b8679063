"""Phrases by pivot partitioning, against counting every n-gram of every piece."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from fragmill.llm import collocations
from fragmill.llm.common import shared_table

SCHEMA = "doc_id long, text string, lang string, phrase string, n long, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "clash", 7, "x") for i, (t, lang) in enumerate(rows)], SCHEMA)


def grams(rows, longest=5):
    """lang -> Counter of word tuples."""
    out = {}
    for text, lang in rows:
        counts = out.setdefault(lang or "und", Counter())
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                counts.update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    return out


def brute(rows, least, first):
    out = []
    for lang, counts in grams(rows).items():
        n = sum(c for g, c in counts.items() if len(g) == 1)
        found = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in found.items():
            if any(b >= a and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in found.items()):
                continue
            score, k = min((1000 * a * n // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def made(seed, docs=60):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "a", "a", "über", "日本", "\x00", "x y", "it's"]
    rows = []
    for _ in range(docs):
        text = "".join(rng.choice([" ", "\t", "  ", ". ", ",", "\n", " ", " "]) + (rng.choice(words) if rng.random() < 0.6 else "new york city hall") for _ in range(rng.randint(0, 80)))
        rows.append((text, rng.choice(["en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", "fr"), (" ,;\n", "fr"), ("a " * 3000, "hot"), (rows[0][0], "en"), (rows[0][0], "en")]


@pytest.mark.parametrize("listed,split,kept", [(500_000, 300_000, 300_000), (3, 20, 300_000), (0, 5, 40), (8, 1, 7)])
def test_against_brute_force(spark, monkeypatch, listed, split, kept):
    """The word list, how pivots are dealt and how many counts a task keeps change no result."""
    rows = made(listed + split)
    counts = shared_table(collocations.word_counts(table(spark, rows)), "test-counts")
    want = grams(rows)
    assert {(r["lang"], r["word"]): r["n"] for r in counts.collect()} == {(lang, g[0]): c for lang, cs in want.items() for g, c in cs.items() if len(g) == 1}
    monkeypatch.setattr(collocations, "KEPT", kept)
    found = collocations.phrases(table(spark, rows).repartition(3), counts, 12, listed=listed, split=split).collect()
    assert {(r["lang"], r["phrase"]): r["f"] for r in found} == {(lang, " ".join(g)): c for lang, cs in want.items() for g, c in cs.items() if len(g) > 1 and c >= 12}
    assert len(found) == len({(r["lang"], r["phrase"]) for r in found})


@pytest.mark.parametrize("least,first", [(12, 2000), (3, 5)])
def test_scores_and_ranks(spark, least, first):
    rows = made(least, 40)
    got = sorted(map(tuple, collocations.collocations(table(spark, rows), least, first).collect()))
    assert got == brute(rows, least, first) and got


def test_exact_beyond_64_bits(spark):
    """1000 * a * n and l * r pass 64 bits."""
    big = 3 * 10**12
    found = spark.createDataFrame([("en", "a b", 2, big + 1)], "lang string, phrase string, n_words int, f long")
    counts = spark.createDataFrame([("en", "a", big + 2), ("en", "b", big + 3), ("en", "c", 10**14 + 7)], "lang string, word string, n long")
    (row,) = collocations.scored(found, counts).collect()
    n = 2 * big + 5 + 10**14 + 7
    assert (row["n"], row["score"]) == (n, 1000 * (big + 1) * n // ((big + 2) * (big + 3)))


def test_empty(spark):
    assert collocations.collocations(table(spark, [])).count() == 0
    assert collocations.collocations(table(spark, [(None, None), ("", "en")])).count() == 0


def test_rows_follow_the_buckets_not_the_pivots(spark, monkeypatch):
    runs = []
    monkeypatch.setattr(collocations, "trimmed", lambda f: runs.append(f) or f)
    rows = [(i, " ".join(f"a{i + k} b{i}" for k in range(20)), "en", None) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    counts = shared_table(collocations.word_counts(df), "test-counts")
    runs.clear()
    collocations.phrases(df, counts, least=1)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(rows)), pa.array([r[1] for r in rows])], names=["lang", "text"])
    made = list(runs[0]([batch]))
    texts = sum(len(x) for b in made for x in b.column(3).to_pylist())
    buckets = collocations.BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert 0 < sum(b.num_rows for b in made) <= buckets + texts // collocations.ROW < len(counts.where("n >= 1").collect()) // 2
