"""Token ids as ORC files: integer run-length encoding, row indexes, Bloom filters on ids.

Texts are encoded where they lie, then dealt to shards that are ranges of document ids; shard
i becomes file i, its rows in ascending id order.  ORC stores array<int> columns with
run-length encoding, keeps min/max row indexes and a Bloom filter of doc_id in every stripe,
so a reader takes stripes in parallel and a look-up by id skips stripes by metadata.

The ids are those of the library's ``encode`` with its settings untouched.  A text is first cut at
the tokenizer's special strings, as the library does on the raw text; between them no piece of the
tokenizer's pattern and no composition of its normaliser crosses ASCII white space.  So pieces are
found in a whole text at once where it has visible ASCII and Latin letters only and the tokenizer
has the known normaliser and pattern, whose work on those is plain; other words go through the
library's normaliser and pre-tokeniser one by one.  Each piece goes through the library's model
once, and up to a fixed number of pieces are remembered.  Texts are whole: nothing is cut.

Defined results: null or empty text is the end id alone; null ids come first; rows that repeat
an id are all written, ties ordered by their token ids; special strings in a text are their
special ids; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fragmill.llm.common import pieces, shared_path

#: Words and pieces remembered by each worker: as many young ones, and as many older ones.
KNOWN = 300_000

# The normaliser and pattern whose effect on ASCII words is known.
PLAIN_STEPS = ("NFC", "Replace", "Lowercase")
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words whose normal form is their lower case: visible ASCII and Latin letters that stay in the range.
_PLAIN = "!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_PLAIN_TEXT = re.compile(f"[{_PLAIN}\t-\r ]*")
_PARTS = re.compile("[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\sa-z0-9\u00df-\u00f6\u00f8-\u017f]+")


def byte_alphabet() -> dict[int, str]:
    """The visible characters that stand for bytes: themselves where visible, else from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


_BYTES = byte_alphabet()


class Known(dict):
    """key -> make(key), remembered for a bounded number of keys: the young ones, and those before them."""

    def __init__(self, make):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, key):
        if len(self) >= KNOWN:
            self.before = dict(self)
            self.clear()
        found = self.before.get(key)
        found = self[key] = self.make(key) if found is None else found
        return found


class Encoder:
    """Texts to packed ids, piece by piece."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.kind = kind
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.plain = tuple(x["type"] for x in steps) == PLAIN_STEPS and [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"].get("Regex") == PLAIN_PATTERN
        added = spec.get("added_tokens", [])
        # Strings that the library takes out of the raw text wherever they are; of others only it knows the rules.
        self.whole = any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in added)
        self.special = {x["content"]: self.packed([x["id"]]) for x in added}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if added else None
        self.tokenize = self.library.model.tokenize
        self.pieces, self.words = Known(self.piece), Known(self.word)

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def piece(self, text: str) -> bytes:
        """Packed ids of a lower-case piece."""
        return self.packed([t.id for t in self.tokenize(text if text.isascii() else text.encode().decode("latin-1").translate(_BYTES))])

    def word(self, raw: bytes) -> bytes:
        text = raw.decode()
        if self.plain and _PLAIN_TEXT.fullmatch(text):
            return b"".join(map(self.pieces.__getitem__, _PARTS.findall(text.lower())))
        whole = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        parts = self.library.pre_tokenizer.pre_tokenize_str(whole) if self.library.pre_tokenizer else [(whole, None)]
        return b"".join(self.packed([t.id for t in self.tokenize(p)]) for p, _ in parts)

    def ordinary(self, text: str) -> bytes:
        """Packed ids of a text without special strings."""
        if self.plain and _PLAIN_TEXT.fullmatch(text):
            return b"".join(map(self.pieces.__getitem__, _PARTS.findall(text.lower())))
        return b"".join(map(self.words.__getitem__, text.encode().split()))

    def encode(self, text: str) -> bytes:
        if self.whole:
            return self.packed(self.library.encode(text, add_special_tokens=False).ids)
        if self.cut is None or not self.cut.search(text):
            return self.ordinary(text)
        return b"".join(self.special[x] if i % 2 else self.ordinary(x) for i, x in enumerate(self.cut.split(text)))


@functools.lru_cache(maxsize=2)
def encoder(path: str, kind: str) -> Encoder:
    return Encoder(path, kind)


def encode_texts(path: str, texts: list[str]) -> list[np.ndarray]:
    """The ids of each text, as the library gives them without adding special tokens."""
    return [np.frombuffer(encoder(path, "<u4").encode(x), "<u4") for x in texts]


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Write doc_id, shard, pos, offset, n_tokens and ids (array<int>) to ``path``."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)] or [0.5], 10_000)).first()[0]  # one number a shard
    bounds = np.array(sorted(set(cuts or [])), np.int64)
    wide = encoder(tokenizer_path, "<u4").library.get_vocab_size() > 1 << 16 or end_id >= 1 << 16
    kind = "<u4" if wide else "<u2"
    end = np.array([end_id], kind).tobytes()

    def encode(batches):
        pack = encoder(tokenizer_path, kind).encode
        for batch in pieces(batches, 1024):
            doc = batch.column(0)
            shard = np.where(doc.is_valid().to_numpy(zero_copy_only=False), np.searchsorted(bounds, doc.fill_null(0).to_numpy(), side="left"), 0)
            rows = [pack(t.as_py()) + end for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([doc, pa.array(shard, pa.int32()), pa.array(rows, pa.binary())], names=["doc_id", "shard", "raw"])

    def unpack(batches):
        pos = offset = 0
        for batch in pieces(batches):
            rows = [np.frombuffer(r, kind) for r in batch.column(2).to_pylist()]
            n = np.array([len(r) for r in rows], np.int64)
            ends = np.cumsum(n)
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.concatenate(rows) if rows else [], pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(pos + np.arange(len(rows))), pa.array(offset + ends - n), pa.array(n), flat],
                names=["doc_id", "shard", "pos", "offset", "n_tokens", "ids"],
            )
            pos += len(rows)
            offset += int(n.sum())

    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    packed = text.mapInArrow(encode, "doc_id long, shard int, raw binary").repartitionById(len(bounds) + 1, F.col("shard"))
    ordered = packed.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "raw")
    rows = ordered.mapInArrow(unpack, "doc_id long, shard int, pos long, offset long, n_tokens long, ids array<int>")
    rows.write.option("compression", "zstd").option("orc.create.index", "true").option("orc.row.index.stride", "1000").option("orc.stripe.size", str(16 << 20)).option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files with ``start``: ids in all documents before."""
    rows = spark.read.schema("doc_id long, shard int, pos long, offset long, n_tokens long, ids array<int>").orc(path)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("words"))  # one row a shard, so that its broadcast is bounded by their number
    base = totals.select("shard", (F.sum("words").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, 0)) - F.col("words")).alias("base"))
    return rows.join(F.broadcast(base), "shard").withColumn("start", F.col("base") + F.col("offset")).drop("base")


def lookup(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """The rows of one document; stripes without it are skipped by index and Bloom filter."""
    return spark.read.schema("doc_id long, shard int, pos long, offset long, n_tokens long, ids array<int>").orc(path).where(F.col("doc_id") == doc_id)


def crc32(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: of the ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in pieces(batches):
            ids = batch.column(2)
            ends = ids.offsets.to_numpy().astype(np.int64) - ids.offsets[0].as_py()
            raw = memoryview(ids.flatten().to_numpy().astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write ``docs`` to the shared folder and read the files back."""
    path = shared_path(docs.sparkSession, "token-orc")
    write(docs, path, tokenizer_path, end_id)
    return read(docs.sparkSession, path)
