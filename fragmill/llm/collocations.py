"""Phrases that occur together more often than chance, mined by pivot partitioning.

Texts are cut at punctuation into pieces and those into words.  A word list by frequency comes from one
aggregation.  Each occurrence of a word is the pivot of the n-grams in which it is the rarest word (of
equal words the leftmost): so its fragment is the words around it, four on each side at most, cut where a
word is rarer, on the left also where it is the same.  Fragments that are equal are counted together before they are
shuffled to their pivot, where n-grams are mined: those, and only those, that hold the pivot's place.  Each
occurrence of an n-gram is thus counted in one fragment, and all of an n-gram's occurrences meet at one pivot.

* Words below ``least`` occurrences are in no candidate, so they cut fragments like punctuation.
* The word list that tasks look words up in has the most frequent ``listed`` words; beyond them any fixed order is
  right (here that of the words' bytes), since it only decides where an n-gram is counted.  Results don't depend on it.
* Pivots travel by buckets, as many as the shuffle has use for: a shuffled row holds fragments of all pivots of a bucket, and
  each names its pivot by its place.
* A pivot of more than ``split`` occurrences is dealt to several buckets, whose counts are added afterwards.
* Memory is bounded: counts kept by a task are emitted as partial counts beyond a fixed number.

Scores are joins of the table of phrases with itself, by first part and by rest, in exact decimals.

Defined results: null and empty texts have no words; null languages are ``und``; repeated rows and ids count as
often as they occur; ties go to the higher count, then to the smaller phrase by bytes; other columns are not
read; very long texts are whole; an empty table gives no phrase.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fragmill.llm.common import pieces, shared_table, trimmed
from fragmill.llm.token_orc import Known

#: Words of a phrase at most.
LONGEST = 5
#: Words that tasks look up, in all languages together.
LISTED = 500_000
#: Occurrences of a pivot that go to one task.
SPLIT = 300_000
#: Counts that a task keeps at once.
KEPT = 300_000
#: Buckets of pivots to a shuffle partition.
BUCKETS = 20
#: Bytes of fragments in a shuffled row.
ROW = 4_000
_PARTS = re.compile(rb"[^\x20\x09-\x0D.,;:!?]+|[\x0A-\x0D.,;:!?]+")
_BREAK = re.compile(rb"[\x0A-\x0D.,;:!?]+")


def _language(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit("und"))


def _parts(text: str | None) -> list[bytes]:
    """Words, A-Z in lower case, and the marks between pieces."""
    return _PARTS.findall(text.encode().lower()) if text else []  # bytes.lower() changes A-Z only


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, word, n."""

    def run(batches):
        seen: dict[str, Counter] = {}

        def emit():
            for lang, counts in seen.items():
                words = [w for w in counts if not _BREAK.match(w)]
                for at in range(0, len(words), 10_000):
                    some = words[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([w.decode() for w in some], pa.string()), pa.array([counts[w] for w in some], pa.int64())], names=["lang", "word", "n"])
            seen.clear()

        for batch in pieces(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.setdefault(lang, Counter()).update(_parts(text))
            if sum(map(len, seen.values())) > KEPT:
                yield from emit()
        yield from emit()

    rows = docs.select(_language(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(trimmed(run), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _fragments(ids: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each occurrence that owns an n-gram: its place, and how many words on the left and right are in its fragment.

    ``ids``: the rank of each word, a smaller one for a more frequent word, and -1 where nothing goes across.
    """
    n = len(ids)
    near = []
    for side in (-1, 1):
        reach, open_ = np.zeros(n, np.int8), ids >= 0
        for k in range(1, longest):
            other = np.full(n, -1, np.int64)
            if k < n:
                if side < 0:
                    other[k:] = ids[:-k]
                else:
                    other[:-k] = ids[k:]
            open_ = open_ & (other >= 0) & ((other < ids) if side < 0 else (other <= ids))
            reach += open_
        near.append(reach)
    at = np.flatnonzero(near[0] + near[1] > 0)
    return at, near[0][at], near[1][at]


def phrases(docs: DataFrame, counts: DataFrame, least: int = 100, longest: int = LONGEST, listed: int = LISTED, split: int = SPLIT, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, phrase, n_words, f of phrases of 2 to ``longest`` words that occur ``least`` times or more.

    ``counts``: the rows of ``word_counts``, as a written table.
    """
    spark = docs.sparkSession
    frequent = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "lang", "word").limit(listed + 1)
    top = [(r["lang"], r["word"].encode(), r["n"]) for r in frequent.collect()]  # at most ``listed`` + 1 rows
    whole = len(top) <= listed
    rank: dict[str, dict[bytes, int]] = {}
    for i, (lang, word, _) in enumerate(top[:listed]):
        rank.setdefault(lang, {})[word] = i
    sent = spark.sparkContext.broadcast((rank, [n // split + 1 for _, _, n in top[:listed]]))
    beyond = len(top)
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def route(batches):
        ranks, shares = sent.value
        seen: dict[tuple, dict] = {}
        held = 0
        bucket_of = Known(lambda word: xxhash.xxh32_intdigest(word) % buckets)

        def emit():
            rows = []
            for (lang, bucket, split_up), fragments in seen.items():
                lines, size = [], 0
                for (left, words), n in fragments.items():
                    lines.append(b"%d %d %b" % (left, n, words))
                    size += len(words)
                    if size > ROW:
                        rows.append((lang, bucket, split_up, b"\n".join(lines)))
                        lines, size = [], 0
                if lines:
                    rows.append((lang, bucket, split_up, b"\n".join(lines)))
            seen.clear()
            for at in range(0, len(rows), 2000):
                columns = zip(*rows[at : at + 2000])
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int32(), pa.bool_(), pa.binary()))], names=["lang", "bucket", "split_up", "fragments"])

        for batch in pieces(batches, 256):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    by_lang.setdefault(lang, []).extend([*_parts(text), b"."])
            for lang, parts in by_lang.items():
                table = ranks.get(lang, {})
                if whole:
                    ids = np.array([table.get(w, -1) for w in parts], np.int64)
                else:
                    others = {w: beyond + i for i, w in enumerate(sorted({w for w in parts if w not in table and not _BREAK.match(w)}))}
                    ids = np.array([table.get(w, others.get(w, -1)) for w in parts], np.int64)
                at, left, right = _fragments(ids, longest)
                for p, a, b, i in zip(at.tolist(), left.tolist(), right.tolist(), ids[at].tolist()):
                    words = b" ".join(parts[p - a : p + b + 1])
                    # A pivot dealt to several tasks: a fragment always goes to the same.
                    split_up = i < len(shares) and shares[i] > 1
                    bucket = bucket_of[parts[p]]
                    if split_up:
                        bucket = (bucket + xxhash.xxh32_intdigest(words) % shares[i]) % buckets
                    of = seen.get((lang, bucket, split_up))
                    if of is None:
                        of = seen[lang, bucket, split_up] = {}
                    n = of.get((a, words))
                    if n is None:
                        n = 0
                        held += 1
                    of[a, words] = n + 1
                if held > KEPT:
                    yield from emit()
                    held = 0
        yield from emit()

    def mine(batches):
        """Rows of a bucket are together; its counts are whole unless its pivots are dealt to several or it had to be emitted before its end."""
        key, partial, seen = None, False, {}

        def emit():
            found = [(w, n) for w, n in seen.items() if partial or n >= least]
            seen.clear()
            for k in range(0, len(found), 10_000):
                some = found[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(some), pa.string()), pa.array([w.decode() for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], names=["lang", "phrase", "f"])

        for batch in pieces(batches):
            for lang, bucket, split_up, fragments in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (lang, bucket, split_up):
                    yield from emit()
                    key, partial = (lang, bucket, split_up), split_up
                for line in fragments.split(b"\n"):
                    left, times, *words = line.split(b" ")
                    at, n = int(left), int(times)
                    for i in range(at + 1):
                        for j in range(max(at + 1, i + 2), min(i + longest, len(words)) + 1):
                            phrase = b" ".join(words[i:j])
                            seen[phrase] = seen.get(phrase, 0) + n
                if len(seen) > KEPT:
                    partial = True
                    yield from emit()
        yield from emit()

    rows = docs.select(_language(lang_col).alias("lang"), F.col(text_col).alias("text"))
    dealt = rows.mapInArrow(trimmed(route), "lang string, bucket int, split_up boolean, fragments binary").repartition("lang", "bucket", "split_up").sortWithinPartitions("lang", "bucket", "split_up")
    mined = dealt.mapInArrow(trimmed(mine), "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return mined.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("n_words"), "f")


def scored(found: DataFrame, counts: DataFrame, least: int = 100) -> DataFrame:
    """lang, phrase, a, l, r, n, score of candidates that no longer one replaces; ``found`` and ``counts`` are written tables.

    Score: the lowest of floor(1000 * a * n / (l * r)) over the places where a phrase can be cut.  A phrase is replaced by
    a longer one of the same count that holds it; one word longer will do, as those between have that count too.
    """
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    every = found.select("lang", "phrase", "f").unionByName(counts.where(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.col("n").alias("f")))
    words = F.split("phrase", " ")
    cut = found.select("lang", "phrase", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    cut = cut.join(every.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(every.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    score = F.expr("(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0))) div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))")
    lowest = cut.select("lang", "phrase", F.struct(score.alias("score"), "k", "l", "r", "a", "n").alias("x")).groupBy("lang", "phrase").agg(F.min("x").alias("x"))
    inner = found.where(F.col("n_words") > 2).select("lang", F.col("f").alias("longer"), F.explode(F.array(F.array_join(F.slice(words, 1, F.col("n_words") - 1), " "), F.array_join(F.slice(words, 2, F.col("n_words") - 1), " "))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("x.a")))
    return kept.select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")


def collocations(docs: DataFrame, least: int = 100, first: int = 2000, longest: int = LONGEST, listed: int = LISTED, split: int = SPLIT) -> DataFrame:
    """The best ``first`` of each language: lang, rank, phrase, a, l, r, n, score."""
    counts = shared_table(word_counts(docs), "word-counts")
    found = shared_table(phrases(docs, counts, least, longest, listed, split), "phrases")
    scores = scored(found, counts, least)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language may be most of the table: first the best of each of its parts, then of what they leave.
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = scores.withColumn("share", F.pmod(F.hash("phrase"), F.lit(shares))).withColumn("rank", F.row_number().over(W.partitionBy("lang", "share").orderBy(*best))).where(F.col("rank") <= first)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
