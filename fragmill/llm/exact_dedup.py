"""Exact deduplication with an extendible-hash index on shared files.

1. Entries: every row's key (64-bit hash of the normalised text), digest and length go to a
   table in the shared folder.
2. Directory: the key space is a binary trie of hash prefixes.  A bucket that holds more than
   ``capacity`` distinct keys splits on the next bit; when its depth passes the directory's,
   the directory doubles.  Only bucket counts reach the driver, at most 2**max_depth rows; buckets
   of that depth no longer split and may hold more than ``capacity`` keys.
3. Owner tasks: each bucket is a key range with one owner.  Copies inside an Arrow batch are
   collapsed before the shuffle, so a group of copies that holds a third of all rows reaches
   its owner as one row a batch.  The owner reads its range in key order, keeps the chain of
   different texts of one key at a time, and compares bytes along the chain.
4. The index (key, place in the chain, digest, best row, size) is written to the shared folder;
   entries get their group by an equi-join on (key, digest), which adaptive execution may split.

Defined results: null text counts as empty; empty texts are copies of each other; of rows that
tie in code points the smallest id stays, a null id counting as the largest; rows that repeat
an id and a text are the same document, and ``kept`` holds on each of them; other columns are
not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.llm.common import SPACE, fresh, pieces, shared_table, trimmed

_COLLAPSED = "bucket long, key long, text string, n long, n_chars long, doc_id long"
_CHAINED = "key long, chain int, text_sha256 string, keep_id long, keep_chars long, group_size long"
_FAR = (1 << 63) - 1


def normalise(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", "")


def raw_key(text: Column) -> Column:
    """A hash of a text as written, which tells rows of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _prefix(depth: int) -> Column:
    """The first ``depth`` bits of a key as a number."""
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int, max_depth: int = 16) -> list[int]:
    """Bucket of each prefix of the directory's depth; its length is 2**depth.

    ``keys`` has one row for each distinct key.  The directory fits the driver at any size of the
    table: at ``max_depth`` buckets stop splitting and hold more keys, which an owner reads one after the other.
    """
    total = keys.count()
    depth = 0
    while depth < max_depth and (total >> depth) > capacity // 2:
        depth += 1
    while True:
        counts = [0] * (1 << depth)
        for row in keys.groupBy(_prefix(depth).alias("p")).count().collect():  # at most 2**max_depth rows
            counts[row["p"]] = row["count"]
        if max(counts) <= capacity or depth == max_depth:
            break
        depth += 1

    slots = [0]  # the directory: slot -> bucket
    depths = {0: 0}  # bucket -> local depth
    starts = {0: 0}  # bucket -> first prefix of its own depth
    below = [0, *itertools.accumulate(counts)]
    now = 0
    queue = [0]
    while queue:
        bucket = queue.pop()
        local = depths[bucket]
        first = starts[bucket] << (now - local)
        width = 1 << (now - local)
        cells = 1 << (depth - now)
        if local >= depth or below[(first + width) * cells] - below[first * cells] <= capacity:
            continue
        if local == now:  # double the directory
            slots = [b for b in slots for _ in (0, 1)]
            now, first, width = now + 1, first * 2, width * 2
        new = len(depths)
        depths[bucket] = depths[new] = local + 1
        starts[bucket], starts[new] = starts[bucket] * 2, starts[bucket] * 2 + 1
        for i in range(first + width // 2, first + width):
            slots[i] = new
        queue += [bucket, new]
    return slots


def _collapse(batches):
    """One row for each different text of some rows."""
    for batch in pieces(batches, 2048):
        found: dict[tuple[int, str], list] = {}
        bucket, key, text, n_chars, ids = (batch.column(i).to_pylist() for i in range(5))
        for i, k in enumerate(zip(key, text)):
            doc = _FAR if ids[i] is None else ids[i]
            got = found.get(k)
            if got is None:
                found[k] = [bucket[i], 1, n_chars[i], doc]
            else:
                got[1] += 1
                if (-n_chars[i], doc) < (-got[2], got[3]):
                    got[2:] = n_chars[i], doc
        rows = list(found.items())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([v[0] for _, v in rows], pa.int64()),
                pa.array([k[0] for k, _ in rows], pa.int64()),
                pa.array([k[1] for k, _ in rows], pa.string()),
                pa.array([v[1] for _, v in rows], pa.int64()),
                pa.array([v[2] for _, v in rows], pa.int64()),
                pa.array([v[3] for _, v in rows], pa.int64()),
            ],
            names=["bucket", "key", "text", "n", "n_chars", "doc_id"],
        )


def _own(batches):
    """Walk a key range in order; memory holds the chain of one key."""
    now, chain = None, []

    def flush():
        rows = [(now, i, hashlib.sha256(c[0].encode()).hexdigest(), None if c[3] == _FAR else c[3], c[2], c[1]) for i, c in enumerate(chain)]
        if len({r[2] for r in rows}) < len(rows):
            raise ValueError(f"different texts share the key {now} and a SHA-256 digest")
        return rows

    for batch in pieces(batches):
        out = []
        _, key, text, n, n_chars, ids = (batch.column(i).to_pylist() for i in range(6))
        for i, k in enumerate(key):
            if k != now:
                if chain:
                    out += flush()
                now, chain = k, []
            for c in chain:
                if c[0] == text[i]:  # bytes
                    c[1] += n[i]
                    if (-n_chars[i], ids[i]) < (-c[2], c[3]):
                        c[2:] = n_chars[i], ids[i]
                    break
            else:
                chain.append([text[i], n[i], n_chars[i], ids[i]])
        if out:
            yield _chained(out)
    if chain:
        yield _chained(flush())


def _chained(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[f.split()[0] for f in _CHAINED.split(", ")])


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, key_bits: int = 64) -> tuple[DataFrame, DataFrame, list[int]]:
    """(entries, index, directory).  ``key_bits`` shortens keys, which makes collisions for tests."""
    spark: SparkSession = docs.sparkSession
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"), normalise(F.col(text_col)).alias("text"), raw_key(F.col(text_col)).alias("text_key"))
    key = F.xxhash64("text") if key_bits == 64 else F.shiftleft(F.shiftrightunsigned(F.xxhash64("text"), 64 - key_bits), 64 - key_bits)
    text = text.withColumn("key", key)
    entries = shared_table(text.select("doc_id", "n_chars", "key", F.sha2("text", 256).alias("text_sha256"), "text_key"), "dedup-entries")

    slots = directory(entries.select("key").distinct(), capacity)
    depth = len(slots).bit_length() - 1
    bucket = F.element_at(F.array(*map(F.lit, slots)), (_prefix(depth) + 1).cast("int")).cast("long") if len(slots) <= 64 else None
    if bucket is None:
        lookup = spark.createDataFrame(list(enumerate(slots)), "slot long, bucket long")  # bounded by 2**max_depth
        text = text.withColumn("slot", _prefix(depth)).join(F.broadcast(lookup), "slot").drop("slot")
    else:
        text = text.withColumn("bucket", bucket)
    owners = text.select("bucket", "key", "text", "n_chars", "doc_id").mapInArrow(trimmed(_collapse), _COLLAPSED)
    owners = owners.repartition("bucket").sortWithinPartitions("bucket", "key")
    index = shared_table(owners.mapInArrow(trimmed(_own), _CHAINED), "dedup-index")
    return entries, index, slots


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, key_bits: int = 64) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chars, text_key."""
    entries, index, _ = build(docs, id_col, text_col, capacity, key_bits)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    return entries.join(index, ["key", "text_sha256"]).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "n_chars", "text_key")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that dedup drops; a row that repeats id and text stays once.

    Rows are known by id and text, so other texts of a repeated id are judged on their own.  Where
    the kept id has its text several times with as many characters, one way of writing stays, and of rows alike in
    id and text that with the least hash of its other columns.  All columns stay, whatever their
    names; an empty table gives an empty result.
    """
    keep, key, times, row, order = fresh(docs, "keep", "keep_key", "times", "row", "order")
    kept = dedup(docs, id_col, text_col).where("kept").groupBy("doc_id", "text_sha256")
    stay = kept.agg(F.min("text_key").alias(key), F.count("*").alias(times)).select(F.col("doc_id").alias(keep), key, times)
    same = docs[id_col].cast("long").eqNullSafe(F.col(keep)) & (raw_key(docs[text_col]) == F.col(key))
    rows = docs.join(stay.select(keep, key), same, "left_semi")
    if stay.where(F.col(times) > 1).isEmpty():
        return rows
    hashed = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    one = rows.select(F.struct(*docs.columns).alias(row), F.col(id_col).alias(keep), raw_key(rows[text_col]).alias(key), F.xxhash64(*hashed).alias(order))
    return one.groupBy(keep, key).agg(F.min_by(row, order).alias(row)).select(f"{row}.*")
