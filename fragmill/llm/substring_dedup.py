"""Substring deduplication by recompression.

Each document's words are recompressed in rounds: first runs of one word get one name, then in
every round adjacent pairs do, where the left name falls into one half of the names and the
right one into the other.  In these rounds names are hashes of what they stand for, so all executors give equal
content equal names without meeting.  With each name goes the stretch of words that decides it:
inside an equal stretch, two documents have the same names.  Rounds end when no stretch is short enough.

Each window of ``length`` words anchors at the highest-level name (of those the greatest hash,
of those the leftmost) whose deciding stretch lies in a fixed region inside the window; a word is
a name of level 0, so every window has one.  Equal windows anchor alike.

The last round is Spark's: the regions of all anchors, as two hashes of 64 bits, are grouped, those
that several documents share get global names, and anchors take these names by a join.  Only shared names
go on: Spark deals their windows' hashes by name in document order, where a window is a repeat if a
smaller document had it before; memory holds the different windows of one name.
Windows are compared by region and window hash, 192 bits of whole-word hashes together.

Steps: (1) anchors of every document, named by Spark; (2) documents with shared names give the
window hashes of these; (3) repeats are grouped by document; (4) covered words go.

Defined results: null or empty text has no words and stays empty; rows with a null id neither
remove nor lose words; rows that repeat an id are judged each by its own text, and never by each
other; fewer words than a window: nothing is removed; other columns pass through ``remove``;
an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.llm.common import WordHashes, drop_shared, fresh, hash_words, mix, pieces, release_shuffles, shared_table, trimmed

#: Words of the region before and from an anchor on; their sum must be below the window's length.
BEFORE, AFTER = 8, 16
#: Words of the documents that are named together.
CHUNK = 50_000
_FAR = 1 << 40
_MEMO = WordHashes()
_MARK = np.array([0x51ED270B7B4F1C3D], np.uint64)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


@functools.lru_cache(maxsize=2)
def _powers(which: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(_BASES[which])
    back = pow(base, -1, 1 << 64)

    def make(b: int) -> np.ndarray:
        steps = np.full(1 << bits, b, np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    return make(base), make(back)


def stretch_hashes(h: np.ndarray, length: int, which: int) -> np.ndarray:
    """Hash of each stretch of ``length`` word hashes, from prefix sums of a polynomial."""
    if len(h) < length:
        return np.zeros(0, np.uint64)
    up, down = _powers(which, max(16, len(h).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])])
    return mix((sums[length:] - sums[:-length]) * down[: len(h) - length + 1])


def word_hashes(raw: bytes) -> np.ndarray:
    return hash_words(raw.split(), _MEMO)


def levels(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(level, name) of the best name that starts at each word, whose region decides it."""
    n = len(h)
    level = np.zeros(n, np.uint8)
    best = h.copy()
    # Runs of a word.
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    run = np.diff(np.concatenate([at, [n]]))
    name = np.where(run > 1, mix(h[at] * _BASES[0] + run.astype(np.uint64)), h[at])
    low = np.where(at > 0, at - 1, -_FAR)
    high = np.where(at + run < n, at + run + 1, _FAR)

    def note(rank, at, name, low, high):
        ok = (low >= at - BEFORE) & (high <= at + AFTER)
        level[at[ok]] = rank
        best[at[ok]] = name[ok]
        return ok.any()

    note(1, at[run > 1], name[run > 1], low[run > 1], high[run > 1])
    for r in itertools.count():
        if len(name) < 2:
            break
        right = (mix(name + np.uint64(r + 1)) >> np.uint64(40)) & np.uint64(1) == 1
        joins = np.concatenate([~right[:-1] & right[1:], [False]])
        eaten = np.concatenate([[False], joins[:-1]])
        paired = mix(name[:-1] * _BASES[0] + mix(name[1:]) + np.uint64(r))
        # A name that stays must know the neighbour that it did not join.
        before_low = np.concatenate([[-_FAR], low[:-1]])
        before_high = np.concatenate([[-_FAR], high[:-1]])
        after_low = np.concatenate([low[1:], [_FAR]])
        after_high = np.concatenate([high[1:], [_FAR]])
        new_low = np.where(joins, np.minimum(low, after_low), np.where(right, np.minimum(low, before_low), np.minimum(low, after_low)))
        new_high = np.where(joins, np.maximum(high, after_high), np.where(right, np.maximum(high, before_high), np.maximum(high, after_high)))
        name = np.where(joins, np.concatenate([paired, np.zeros(1, np.uint64)]), name)
        if not note(r + 2, at[joins], name[joins], new_low[joins], new_high[joins]) and r > 0:
            break
        keep = ~eaten
        name, at, low, high = name[keep], at[keep], new_low[keep], new_high[keep]
    return level, best


def joined(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One array of all documents' words, a mark after each, and where each document starts.

    A name that a mark has helped to decide has a stretch that holds the mark, and no region inside a document does.
    """
    starts = np.cumsum([0, *(len(h) + 1 for h in hashes)])[:-1]
    return np.concatenate([x for h in hashes for x in (h, _MARK)]), starts


def anchors(hashes: list[np.ndarray], length: int) -> tuple[np.ndarray, ...]:
    """(document, key, second key, first window, windows) of each anchor of some documents."""
    h, starts = joined(hashes)
    sizes = np.array([len(x) for x in hashes], np.int64)
    if not len(sizes) or sizes.max() < length:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    windows = len(h) - length + 1
    level, best = levels(h)
    rank = (level.astype(np.uint64) << np.uint64(60)) | (mix(best) >> np.uint64(4))
    width = length - BEFORE - AFTER + 1
    top = rank[BEFORE : len(h) - AFTER + 1]
    where = np.arange(BEFORE, BEFORE + len(top))
    size = 1

    def better(v, i, step):
        a, b = v[: len(v) - step], v[step:]
        later = b > a  # the leftmost of equals stays
        return np.where(later, b, a), np.where(later, i[step:], i[: len(i) - step])

    while size * 2 <= width:
        top, where = better(top, where, size)
        size *= 2
    if size < width:
        top, where = better(top, where, width - size)
    doc = np.repeat(np.arange(len(sizes)), sizes + 1)[:windows]
    local = np.arange(windows) - starts[doc]
    inside = np.flatnonzero(local + length <= sizes[doc])
    where, doc, local = where[inside], doc[inside], local[inside]
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    key, second = (stretch_hashes(h, BEFORE + AFTER, k)[where[first] - BEFORE].view(np.int64) for k in (0, 1))
    return doc[first], key, second, local[first], np.diff(np.concatenate([first, [len(where)]]))


def chunks(batches, text_at: int):
    """(rows, word hashes of each) of some documents at a time: as many as have CHUNK words together."""
    for batch in pieces(batches, 1024):
        hashes, words, begin = [], 0, 0
        for i, t in enumerate(batch.column(text_at).cast(pa.binary())):
            hashes.append(word_hashes(t.as_py()))
            words += len(hashes[-1])
            if words >= CHUNK:
                yield batch.slice(begin, i + 1 - begin), hashes
                hashes, words, begin = [], 0, i + 1
        if hashes:
            yield batch.slice(begin), hashes


def _anchored(length: int):
    def run(batches):
        for rows, hashes in chunks(batches, 2):
            doc, key, second, first, n = anchors(hashes, length)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(second), rows.column(0).take(take), rows.column(1).take(take), pa.array(first), pa.array(n.astype(np.int32))], names=["key", "second", "doc_id", "text_key", "first", "n"])

    return run


def _windowed(length: int):
    """doc_id, text_key, text, anchors -> the window hashes of each shared anchor."""

    def run(batches):
        for rows, hashes in chunks(batches, 2):
            h, starts = joined(hashes)
            w = stretch_hashes(h, length, 1)
            names, owner, firsts, packed = [], [], [], []
            for i, shared in enumerate(rows.column(3).to_pylist()):
                at = int(starts[i])
                for a in shared:
                    names.append(a["name"])
                    owner.append(i)
                    firsts.append(a["first"])
                    packed.append(w[at + a["first"] : at + a["first"] + a["n"]].tobytes())
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), rows.column(0).take(take), rows.column(1).take(take), pa.array(firsts, pa.int64()), pa.array(packed, pa.binary())],
                names=["name", "doc_id", "text_key", "first", "hashes"],
            )

    return run


def _repeated(batches):
    """Rows in order of (name, doc_id) -> ranges of windows that a smaller document has."""
    now, seen = None, {}
    for batch in batches:
        name, doc, text_key, first, packed = (batch.column(i).to_pylist() for i in range(5))
        out = []
        for i, k in enumerate(name):
            if k != now:
                now, seen = k, {}
            d = doc[i]
            hit = [seen.setdefault(w, d) < d for w in np.frombuffer(packed[i], np.uint64).tolist()]
            if True in hit:
                flags = np.diff(np.concatenate([[0], np.array(hit, np.int8), [0]]))
                out += [(d, text_key[i], first[i] + int(a), first[i] + int(b)) for a, b in zip(np.flatnonzero(flags == 1), np.flatnonzero(flags == -1))]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], names=["doc_id", "text_key", "first", "end"])


def repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, ranges: array<struct<first, end>> of repeated windows, by document."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    found = source.mapInArrow(trimmed(_anchored(length)), "key long, second long, doc_id long, text_key long, first long, n int")
    found = shared_table(found, "repeat-anchors")
    # The naming round: a row for each name and task before the shuffle.
    names = found.groupBy("key", "second").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    names = shared_table(names.select("key", "second", F.monotonically_increasing_id().alias("name")), "repeat-names")
    mine = found.join(names, ["key", "second"]).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("name", "first", "n")).alias("anchors"))  # as many as a text has
    mine = shared_table(mine, "repeat-shared")
    drop_shared(spark, found, names)
    release_shuffles(spark)
    hashed = source.join(mine, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "anchors")
    hashed = hashed.mapInArrow(trimmed(_windowed(length)), "name long, doc_id long, text_key long, first long, hashes binary")
    hashed = hashed.repartition("name").sortWithinPartitions("name", "doc_id")
    ranges = hashed.mapInArrow(trimmed(_repeated), "doc_id long, text_key long, first long, end long")
    ranges = shared_table(ranges.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "end")).alias("ranges")), "repeat-ranges")
    drop_shared(spark, mine)
    release_shuffles(spark)
    return ranges


def _kept(length: int, text_at: int, ranges_at: int):
    def run(batches):
        for batch in pieces(batches):
            n_words, n_removed, kept = [], [], []
            ranges = batch.column(ranges_at).to_pylist()
            for i, t in enumerate(batch.column(text_at).cast(pa.binary())):
                words = (t.as_py() or b"").split()
                n = len(words)
                if ranges[i]:
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, [r["first"] for r in ranges[i]], 1)
                    np.add.at(change, [r["end"] + length - 1 for r in ranges[i]], -1)
                    stay = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
                    words = [words[j] for j in stay]
                n_words.append(n)
                n_removed.append(n - len(words))
                kept.append(b" ".join(words))
            columns = [c for k, c in enumerate(batch.columns) if k != ranges_at]
            names = [c for k, c in enumerate(batch.schema.names) if k != ranges_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[*names, "n_words", "n_removed", "kept_text"])

    return run


def remove(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (kept words joined by one space)."""
    docs = docs.drop("n_words", "n_removed", "kept_text")
    name, repeat_id, repeat_key = fresh(docs, "ranges", "repeat_id", "repeat_key")
    ranges = repeats(docs, length, id_col, text_col).withColumnsRenamed({"doc_id": repeat_id, "text_key": repeat_key, "ranges": name})
    same = (docs[id_col].cast("long") == F.col(repeat_id)) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col(repeat_key))
    rows = docs.join(ranges, same, "left").select(*docs.columns, name)
    schema = docs.select("*", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept_text")).schema
    return rows.mapInArrow(trimmed(_kept(length, docs.columns.index(text_col), len(docs.columns))), schema)
