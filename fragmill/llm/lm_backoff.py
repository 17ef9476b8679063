"""Stupid-backoff scores of documents under the bigrams of all other documents.

A word after its predecessor scores c(ab) / c(a), or where ab is unseen ``BACKOFF`` times
c(b) / N, or where b is unseen as well ``BACKOFF`` squared / N.  Counts are those of the whole
corpus less the document's own (leave one out), so a document does not vouch for itself.

Documents are dealt to chunks of a bounded size by a hash of their content.  A chunk explodes its
texts to n-grams and pre-aggregates them, so that a very frequent n-gram is one entry a
chunk; entries go to count tables partitioned by n-gram hash.  Each partition sums its entries
and answers every chunk with what other chunks have of its n-grams, in the order asked: a bit for each, and the counts
of those that others have.  The chunk joins them to its
exploded n-grams and sums the log scores of each document.  Entries of one chunk and partition
travel as packed arrays in one row, and only where there are any, so there are never more rows than entries and what
moves grows with the corpus; no task takes more than its chunk or its partition.

Defined results: words are runs of anything but ASCII white space, lower-cased A-Z; null, empty
or word-less text has n_words 0, log_score 0 and a null mean; repeated rows and ids each count
as documents; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.llm.common import WordHashes, hash_words, mix, release_shuffles, shared_table, trimmed

BACKOFF = 0.4
#: Characters of text in a chunk, and of the texts whose entries fill a partition, on average.
CHUNK_CHARS = 12_000_000
PART_CHARS = 12_000_000
_MEMO = WordHashes()
_START = np.uint64(0x517CC1B727220A95)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def grams(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, predecessors, bigrams) of a text, hashed; the first word follows a start mark."""
    words = hash_words(raw.lower().split(), _MEMO)
    before = np.concatenate([np.full(min(1, len(words)), _START), words[:-1]])
    return words, before, mix(before * _ODD + mix(words))


def _slices(keys: np.ndarray, parts: int) -> np.ndarray:
    """Ends of the ranges of sorted keys that fall to each partition."""
    edges = np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _counted(parts: int):
    """A chunk's (chunk, text) -> packed distinct n-grams and counts for each partition.

    Order 1 are words, order 0 the words that precede another (with the start mark), order 2 bigrams.
    """

    def run(batches):
        chunk, found = None, ([], [], [])
        for batch in batches:
            if batch.num_rows:
                chunk = batch.column(0)[0].as_py()
            for t in batch.column(1).cast(pa.binary()):
                for to, x in zip(found, grams(t.as_py())):
                    to.append(x)
        if chunk is None:
            return
        for order, x in ((1, found[0]), (0, found[1]), (2, found[2])):
            keys, counts = np.unique(np.concatenate(x) if x else np.zeros(0, np.uint64), return_counts=True)
            ends = _slices(keys, parts)
            rows = [(k, keys[a:b].tobytes(), counts[a:b].astype("<u4").tobytes()) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if a < b]
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk] * n, pa.int32()), pa.array([order] * n, pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                names=["part", "chunk", "gram", "keys", "counts"],
            )

    return run


def _summed(batches):
    """All entries of a partition -> for each chunk what the others have, in the order of its keys."""
    rows: dict[int, list] = {}
    part = None
    for batch in batches:
        p, chunk, order, keys, counts = (batch.column(i).to_pylist() for i in range(5))
        part = p[0] if p else part
        for c, o, k, n in zip(chunk, order, keys, counts):
            rows.setdefault(o, []).append((c, np.frombuffer(k, np.uint64), np.frombuffer(n, "<u4")))
    for order, entries in rows.items():
        keys, at = np.unique(np.concatenate([e[1] for e in entries]), return_inverse=True)
        totals = np.bincount(at, weights=np.concatenate([e[2] for e in entries]), minlength=len(keys)).astype(np.int64)
        everything = int(totals.sum())
        rows_out = []
        for (chunk, _, own), i in zip(entries, np.split(at, np.cumsum([len(e[1]) for e in entries])[:-1])):
            others = totals[i] - own
            told = others[others > 0]
            wide = bool(len(told)) and int(told.max()) >= 1 << 32
            rows_out.append((chunk, len(own), np.packbits(others > 0).tobytes(), wide, told.astype("<i8" if wide else "<u4").tobytes()))
        n = len(rows_out)
        col = lambda k, kind: pa.array([r[k] for r in rows_out], kind)  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays(
            [col(0, pa.int32()), pa.array([part] * n, pa.int32()), pa.array([order] * n, pa.int32()), pa.array([everything] * n, pa.int64()), col(1, pa.int64()), col(2, pa.binary()), col(3, pa.bool_()), col(4, pa.binary())],
            names=["chunk", "part", "gram", "everything", "asked", "had", "wide", "counts"],
        )


def _scored(everything: int):
    return lambda batches: _scores(batches, everything)


def _scores(batches, everything: int):
    """A chunk's documents, then what others have of its n-grams by (gram, part) -> scores."""
    ids, texts, others = [], [], {0: [], 1: [], 2: []}
    for batch in batches:
        for i, g in enumerate(batch.column(1).to_pylist()):
            if g < 0:
                ids.append(batch.column(3)[i].as_py())
                texts.append(grams(batch.column(4)[i].as_py().encode()))
            else:
                asked, had, wide, counts = (batch.column(k)[i].as_py() for k in range(5, 9))
                told = np.zeros(asked, np.int64)
                told[np.unpackbits(np.frombuffer(had, np.uint8), count=asked).astype(bool)] = np.frombuffer(counts, "<i8" if wide else "<u4")
                others[g].append(told)
    if not ids:
        return
    ends = np.cumsum([0, *(len(t[0]) for t in texts)])
    found = {}  # gram -> (place of each position's n-gram, totals)
    for g, which in ((1, 0), (0, 1), (2, 2)):
        _, at, here = np.unique(np.concatenate([t[which] for t in texts]), return_inverse=True, return_counts=True)
        found[g] = at, here + np.concatenate([np.zeros(0, np.int64), *others[g]])

    def rest(g: int, i: int) -> np.ndarray:
        """Counts of document i's n-grams in all other documents."""
        at, total = found[g]
        own, back, n = np.unique(at[ends[i] : ends[i + 1]], return_inverse=True, return_counts=True)
        return (total[own] - n)[back]

    n_words, scores, seen2 = [], [], []
    for i, (words, _, _) in enumerate(texts):
        n_words.append(len(words))
        if not len(words):
            scores.append(0.0)
            seen2.append(0)
            continue
        rest_words = max(everything - len(words), 1)
        c2, c0, c1 = rest(2, i), rest(0, i), rest(1, i)
        low = np.where(c1 > 0, BACKOFF * np.maximum(c1, 1), BACKOFF * BACKOFF) / rest_words
        s = np.where(c2 > 0, np.maximum(c2, 1) / np.maximum(c0, 1), low)
        scores.append(math.fsum(np.log(s).tolist()))
        seen2.append(int((c2 > 0).sum()))
    mean = [s / n if n else None for s, n in zip(scores, n_words)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(seen2, pa.int64()), pa.array(scores, pa.float64()), pa.array(mean, pa.float64())],
        names=["doc_id", "n_words", "n_seen_bigrams", "log_score", "mean_log_score"],
    )


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, part_chars: int = PART_CHARS) -> DataFrame:
    """doc_id, n_words, n_seen_bigrams, log_score (natural), mean_log_score of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = int(docs.agg(F.sum(F.length(text))).first()[0] or 0)
    chunks, parts = size // chunk_chars + 1, size // part_chars + 1
    # Documents with equal ids and texts share a chunk, which is harmless.
    chunk = F.pmod(F.xxhash64(F.col(id_col), text), F.lit(chunks)).cast("int")
    source = docs.select(chunk.alias("chunk"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    dealt = source.select("chunk", "text").repartitionById(chunks, F.col("chunk"))
    entries = dealt.mapInArrow(trimmed(_counted(parts)), "part int, chunk int, gram int, keys binary, counts binary")
    entries = entries.repartitionById(parts, F.col("part"))
    told = "chunk int, part int, gram int, everything long, asked long, had binary, wide boolean, counts binary"
    answers = shared_table(entries.mapInArrow(trimmed(_summed), told), "backoff-answers")
    del dealt, entries  # else their shuffle files stay
    release_shuffles(docs.sparkSession, wait=0.7)
    everything = answers.where("gram = 1").select("part", "everything").distinct().agg(F.sum("everything")).first()[0] or 0  # one row a partition
    none = lambda kind: F.lit(None).cast(kind)
    asking = source.select("chunk", F.lit(-1).alias("gram"), F.lit(-1).alias("part"), "doc_id", "text", none("long").alias("asked"), none("binary").alias("had"), none("boolean").alias("wide"), none("binary").alias("counts"))
    told = answers.select("chunk", "gram", "part", none("long").alias("doc_id"), none("string").alias("text"), "asked", "had", "wide", "counts")
    both = asking.unionByName(told).repartitionById(chunks, F.col("chunk")).sortWithinPartitions("gram", "part")
    return both.mapInArrow(trimmed(_scored(int(everything))), "doc_id long, n_words long, n_seen_bigrams long, log_score double, mean_log_score double")
