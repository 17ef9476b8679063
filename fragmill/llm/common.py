"""Helpers that the training-data operators share: words, hashes, shared tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word rule here, as a Java regex class.
SPACE = r"[\x20\x09-\x0D]"
#: A word: a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"

_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it on a cluster.  Only where that is unset (tests,
    a single machine) a temporary folder is made and set as the checkpoint folder.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    made = getattr(shared_dir, "made", None)
    if made is None:
        made = shared_dir.made = "file://" + tempfile.mkdtemp(prefix="fragmill-shared-")
        spark.sparkContext.setCheckpointDir(made)
    return made


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/fragmill/{name}-{uuid.uuid4().hex}"
    for seen in _scopes:
        seen.append(path)
    return path


#: Lists that take the paths of shared tables while their scope is open.
_scopes: list[list[str]] = []


@contextlib.contextmanager
def tables_made():
    """A list of the shared paths that are made inside the block."""
    seen: list[str] = []
    _scopes.append(seen)
    try:
        yield seen
    finally:
        _scopes.remove(seen)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def folders_of(df: DataFrame) -> set[str]:
    """Last parts of the folders that ``df`` reads files from."""
    return {f.rsplit("/", 2)[-2] for f in df.inputFiles()}


def drop_shared(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by shared_table once nothing reads them any more."""
    drop_paths(spark, [name for table in tables for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}])


def release_shuffles(spark: SparkSession, wait: float = 0.1) -> None:
    """Let Spark delete shuffle files that nothing reads any more: its cleaner goes by the driver's garbage.

    ``wait``: seconds for Python and the cleaner, which both work in the background, where the disk is short.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(wait)
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of ``df``'s, for helper columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def count_words(col: Column) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a fixed number of words."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def pieces(batches, rows: int = 512):
    """The same rows in smaller batches, so that what a step makes of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def trimmed(run):
    """``run`` for mapInArrow; when it ends, the worker gives the memory it has freed back to the machine."""

    def and_release(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without malloc_trim
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return and_release


def hash_words(words: list[bytes], memo: WordHashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    x = x + _ODD
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def sequence_hashes(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes, order included."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - n + 1, np.uint64(seed + n))
    for k in range(n):
        out = mix(out * _ODD + h[k : len(h) - n + 1 + k])
    return out
