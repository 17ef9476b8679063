"""A trained byte-pair model over fragments, and its encoding and decoding plans.

Ids: 0-255 bytes, then merges, then DOT, PAD, BOS, EOS and UNK, then additional tokens.
"""

from __future__ import annotations

import functools
import json
import random
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.functions import safe
from fragmill.functions.columns import safe_fragments
from fragmill.operators import tokens as tk
from fragmill.sources.shared import checkpointed

# Special tokens in the order of their ids.
SPECIAL = (".", "<pad>", "<bos>", "<eos>", "<unk>")
#: Merges up to which the fold is nested replacements in built-in expressions.
NESTED = 200


@functools.lru_cache(maxsize=8)
def _fold(merges: tuple[tuple[int, int, int], ...]):
    steps = [(tk.symbol(a) + tk.symbol(b), tk.symbol(z)) for a, b, z in merges]

    @functools.lru_cache(maxsize=50_000)
    def short(text: str) -> tuple[int, ...]:
        return run(text)

    def run(text: str) -> tuple[int, ...]:
        word = text.encode().decode("latin-1")
        for pair, new in steps:
            if pair in word:
                word = word.replace(pair, new)
        return tuple(map(tk.token, word))

    return lambda text: short(text) if len(text) <= 200 else run(text)


@dataclass
class FragmentTokenizer:
    """The model.  ``merges``: (left, right) by rank; the new id is 256 + rank."""

    merges: list[tuple[int, int]] = field(default_factory=list)
    additional: list[str] = field(default_factory=list)

    # Ids.
    @property
    def num_merges(self) -> int:
        return len(self.merges)

    @property
    def dot_token_id(self) -> int:
        return 256 + self.num_merges

    @property
    def pad_token_id(self) -> int:
        return self.dot_token_id + 1

    @property
    def bos_token_id(self) -> int:
        return self.dot_token_id + 2

    @property
    def eos_token_id(self) -> int:
        return self.dot_token_id + 3

    @property
    def unk_token_id(self) -> int:
        return self.dot_token_id + 4

    @property
    def num_additional_tokens(self) -> int:
        return len(self.additional)

    @property
    def vocab_size(self) -> int:
        return 256 + self.num_merges + len(SPECIAL) + len(self.additional)

    def additional_ids(self) -> dict[str, int]:
        return {t: self.dot_token_id + len(SPECIAL) + i for i, t in enumerate(self.additional)}

    def add_tokens(self, names: Iterable[str]) -> None:
        """Append names that are not there yet; a name given twice is added once."""
        for name in names:
            if name not in self.additional:
                self.additional.append(name)

    def get_vocab(self) -> list[bytes]:
        """Bytes of each id."""
        vocab = [bytes([i]) for i in range(256)]
        for a, b in self.merges:
            vocab.append(vocab[a] + vocab[b])
        return vocab + [s.encode() for s in (*SPECIAL, *self.additional)]

    def triples(self) -> tuple[tuple[int, int, int], ...]:
        return tuple((a, b, 256 + i) for i, (a, b) in enumerate(self.merges))

    # Scalars.
    def encode(self, smiles: str, add_special_tokens: bool = False, shuffle: bool = False) -> list[int]:
        found = self.additional_ids().get(smiles)
        if found is not None:
            ids = [found]
        else:
            parts = safe.fragments(smiles)
            if shuffle:
                random.shuffle(parts)
            ids = self._joined(parts)
        return [self.bos_token_id, *ids, self.eos_token_id] if add_special_tokens else ids

    def _joined(self, parts: list[str]) -> list[int]:
        fold, ids = _fold(self.triples()), []
        for i, part in enumerate(parts):
            ids += [self.dot_token_id] * (i > 0)
            ids += fold(part)
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """Bytes of known ids, joined, then read as UTF-8 with U+FFFD for what is none."""
        vocab = self.get_vocab()
        return b"".join(vocab[i] for i in ids if 0 <= i < len(vocab)).decode("utf-8", "replace")

    def batch_encode(self, smiles: list[str], max_length: int | None = None, shuffle: bool = False, add_special_tokens: bool = False) -> np.ndarray:
        """(rows, length) of uint32, padded to ``max_length`` or to the longest row."""
        rows = []
        for s in smiles:
            ids = self.encode(s, shuffle=shuffle)
            if max_length is not None:
                ids = ids[: max(0, max_length - 2) if add_special_tokens else max_length]
            rows.append([self.bos_token_id, *ids, self.eos_token_id] if add_special_tokens else ids)
        return self.to_numpy(rows, max_length)

    def to_numpy(self, rows: list[list[int]], length: int | None = None) -> np.ndarray:
        if not rows:
            return np.zeros((0, 0), np.uint32)
        length = max(map(len, rows)) if length is None else length
        out = np.full((len(rows), length), self.pad_token_id, np.uint32)
        for i, r in enumerate(rows):
            out[i, : min(len(r), length)] = r[:length]
        return out

    def batch_decode(self, rows: Iterable[Iterable[int]]) -> list[str]:
        return [self.decode(r) for r in rows]

    # Files.
    def save(self, path: str) -> None:
        merges = [[[a, b], 256 + i] for i, (a, b) in enumerate(self.merges)]
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"version": 1, "merges": merges, "num_merges": len(merges), "additional_tokens": self.additional}, f, indent=2, ensure_ascii=False)

    @classmethod
    def load(cls, path: str) -> FragmentTokenizer:
        """Reads a saved model; ids that do not fit the layout are an error."""
        try:
            with open(path, encoding="utf-8") as f:
                found = json.load(f)
            merges = sorted(((int(z), int(a), int(b)) for (a, b), z in found["merges"]))
        except (ValueError, KeyError, TypeError) as e:
            raise OSError(f"no model in {path}: {e}") from e
        if any(z != 256 + i or max(a, b) >= z or min(a, b) < 0 for i, (z, a, b) in enumerate(merges)):
            raise OSError(f"no model in {path}: merges are not numbered in order")
        return cls([(a, b) for _, a, b in merges], list(found.get("additional_tokens", [])))

    # Tables.
    def merges_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, a, b, z) for i, (a, b, z) in enumerate(self.triples())], "rank int, left_id int, right_id int, new_id int")

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        kinds = ["byte"] * 256 + ["merge"] * self.num_merges + ["special"] * len(SPECIAL) + ["additional"] * len(self.additional)
        return spark.createDataFrame([(i, bytearray(b), k) for i, (b, k) in enumerate(zip(self.get_vocab(), kinds))], "id int, bytes binary, kind string")

    # Columns.
    def word_column(self, text: Column) -> Column:
        """The token string of one fragment, in built-in expressions (up to NESTED merges)."""
        word = tk.byte_word(text)
        for a, b, z in self.triples():
            word = tk.merged(word, a, b, z)
        return word

    def fragment_ids(self, text: Column) -> Column:
        """array<int>: ids of one fragment."""
        if self.num_merges <= NESTED:
            return tk.tokens_of(self.word_column(text))
        triples = self.triples()

        @F.pandas_udf("array<int>")
        def run(s: pd.Series) -> pd.Series:
            fold = _fold(triples)
            return s.map(lambda t: None if t is None else list(fold(t)))

        return run(text)

    def fragments_ids(self, fragments: Column) -> Column:
        """array<int>: ids of an array of fragments, DOT between them."""
        dot = F.lit(self.dot_token_id)
        if self.num_merges <= NESTED:
            each = F.transform(fragments, lambda f: tk.tokens_of(self.word_column(f)))
            return F.aggregate(each, F.array().cast("array<int>"), lambda acc, ids: F.concat(acc, F.array(dot), ids), lambda acc: F.slice(acc, 2, F.greatest(F.size(acc) - 1, F.lit(0))))
        model = self

        @F.pandas_udf("array<int>")
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda parts: None if parts is None else model._joined(list(parts)))

        return run(fragments)

    def encode_table(self, df: DataFrame, smiles: str = "smiles", to: str = "ids", shuffle: bool = False, seed: int | None = None, add_special_tokens: bool = False, max_length: int | None = None, pad: bool = False, fragments_to: str | None = None) -> DataFrame:
        """Add ``to``: array<int> for each row.  Rows that are an additional token skip the kernel.

        ``fragments_to`` keeps the fragments as well (null for additional tokens).
        """
        known = self.additional_ids()
        table = F.create_map(*[x for t, i in known.items() for x in (F.lit(t), F.lit(i))]) if known else None
        hit = F.try_element_at(table, F.col(smiles)) if known else F.lit(None).cast("int")
        parts = safe_fragments(F.when(hit.isNull(), F.col(smiles)))
        if shuffle:
            parts = F.shuffle(parts) if seed is None else F.shuffle(parts, F.lit(seed))
        out = df.withColumn("_fragments", parts)
        ids = F.when(hit.isNotNull(), F.array(hit)).otherwise(self.fragments_ids(F.col("_fragments")))
        if max_length is not None:
            ids = tk.truncated(ids, max_length - 2 if add_special_tokens else max_length)
        if add_special_tokens:
            ids = tk.wrapped(ids, self.bos_token_id, self.eos_token_id)
        out = out.withColumn(to, ids)
        out = out.withColumnRenamed("_fragments", fragments_to) if fragments_to else out.drop("_fragments")
        if pad and max_length is not None:
            return out.withColumn(to, tk.padded(F.col(to), max_length, self.pad_token_id))
        if pad:
            out = checkpointed(out)  # the longest row must be known first; the kernel runs once
            longest = out.agg(F.max(F.size(to))).first()[0] or 0
            return out.withColumn(to, tk.padded(F.col(to), longest, self.pad_token_id))
        return out

    def decoded(self, ids: Column) -> Column:
        """The text of ids, in built-in expressions: unknown ids are skipped, bytes repaired at the end."""
        vocab = F.array(*[F.lit(b.decode("latin-1")) for b in self.get_vocab()])
        known = F.filter(ids, lambda i: (i >= 0) & (i < self.vocab_size))
        text = F.array_join(F.transform(known, lambda i: F.get(vocab, i)), "")
        return F.make_valid_utf8(F.encode(text, "ISO-8859-1").cast("string"))
