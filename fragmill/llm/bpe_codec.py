"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

``encode`` adds the token ids of each whole text; ``decode`` turns ids back into raw bytes.
Both are narrow maps over Arrow batches: no shuffle, and a lost executor only repeats its
own partitions.

Long texts are cut where a match of the split pattern must end anyway: between a character
that is not white space and a white-space character.  No alternative of the pattern matches
across such a place, and its only look-ahead asks about what follows white space, which is
never the last character of a segment.  A segment that is still long (no white space at all)
is split match by match, so each piece goes to the merges on its own.

A text that a batch holds several times, as a mix of epochs does, is encoded and decoded once in that batch.

Defined results: null or empty text -> no ids; ids of null -> empty bytes; repeated rows are
kept; ids outside the vocabulary raise; other columns pass through, and a column that already
has the output's name is replaced.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fragmill.llm.common import pieces, trimmed

#: Code points from which a text is cut at safe boundaries.
LONG = 100_000
#: Code points of a segment, at least; it ends at the next safe boundary.
SEGMENT = 50_000
_SAFE = re.compile(r"(?<=\S)(?=\s)")


@functools.lru_cache(maxsize=4)
def codec(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local-ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def segments(text: str, least: int = SEGMENT) -> Iterator[str]:
    """Cut at the first safe boundary after each ``least`` code points."""
    at = 0
    while len(text) - at > least:
        found = _SAFE.search(text, at + least)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def encode_text(enc: tiktoken.Encoding, text: str, long: int = LONG, least: int = SEGMENT) -> list[int]:
    if len(text) <= long:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in segments(text, least):
        if len(part) <= 2 * least:
            ids += enc.encode_ordinary(part)
        else:
            for piece in regex.finditer(enc._pat_str, part):
                ids += enc._encode_single_piece(piece[0].encode())
    return ids


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [i for i, c in enumerate(batch.schema.names) if c != name]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [values], names=[batch.schema.names[i] for i in keep] + [name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind, True)])


def encode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", to: str = "token_ids") -> DataFrame:
    """Add ``to``: array<int>, the ids of the whole text, without special tokens."""

    def run(batches):
        enc = codec(rank_file, pattern)
        for batch in pieces(batches):
            texts = batch.column(batch.schema.get_field_index(text_col))
            lengths, parts, known = [0], [], {None: np.zeros(0, np.int32), "": np.zeros(0, np.int32)}
            for s in texts.to_pylist():
                ids = known.get(s)
                if ids is None:
                    ids = known[s] = np.array(encode_text(enc, s), np.int32)
                lengths.append(len(ids))
                parts.append(ids)
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), pa.array(np.concatenate(parts or [np.zeros(0, np.int32)])))
            yield _with(batch, to, ids)

    return docs.mapInArrow(trimmed(run), _schema(docs, to, T.ArrayType(T.IntegerType())))


def decode(tokens: DataFrame, rank_file: str, pattern: str, ids_col: str = "token_ids", to: str = "decoded") -> DataFrame:
    """Add ``to``: binary, the raw bytes of the ids; nothing is repaired or replaced."""

    def run(batches):
        enc = codec(rank_file, pattern)
        for batch in pieces(batches):
            rows, known = batch.column(batch.schema.get_field_index(ids_col)), {}
            out = []
            for r in rows:
                ids = r.values.to_numpy(zero_copy_only=False) if r.is_valid else np.zeros(0, np.int32)
                key = ids.tobytes()
                text = known.get(key)
                if text is None:
                    text = known[key] = enc.decode_bytes(ids.tolist())
                out.append(text)
            yield _with(batch, to, pa.array(out, pa.binary()))

    return tokens.mapInArrow(trimmed(run), _schema(tokens, to, T.BinaryType()))
