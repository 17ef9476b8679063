"""The plain Python surface: strings and lists in, strings, lists and arrays out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from fragmill.functions.columns import safe_encode as _column
from fragmill.functions.safe import InvalidSmiles, encode
from fragmill.plans.model import FragmentTokenizer
from fragmill.sources.tables import from_list

__all__ = ["InvalidSmiles", "SafeTokenizer", "encode_batch", "safe_encode"]


def safe_encode(smiles: str) -> str:
    """One string; a ValueError where it is no molecule."""
    return encode(smiles)


def encode_batch(smiles: list[str | None], n_jobs: int | None = None, spark: SparkSession | None = None) -> list[str | None]:
    """A list through Spark, in order; None where a string is no molecule."""
    if not smiles:
        return []
    spark = spark or SparkSession.builder.getOrCreate()
    rows = from_list(spark, smiles)
    rows = rows.repartition(n_jobs) if n_jobs else rows
    return [r["safe"] for r in rows.select("mol_id", _column("smiles").alias("safe")).orderBy("mol_id").collect()]


class SafeTokenizer(FragmentTokenizer):
    """The model with training in place."""

    def train_from_iterator(self, iterator: Iterable[str], vocab_size: int, buffer_size: int = 8192, spark: SparkSession | None = None) -> None:
        from fragmill.plans.trainer import BpeTrainer
        from fragmill.sources.tables import from_iterator

        spark = spark or SparkSession.builder.getOrCreate()
        self.merges = BpeTrainer(vocab_size).fit(from_iterator(spark, iterator, buffer_size)).merges
