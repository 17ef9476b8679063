"""Encoding as a stream: the same columns as in batch, so nothing is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.functions.columns import safe_encode, safe_fragments
from fragmill.plans.model import FragmentTokenizer


def encoded(stream: DataFrame, smiles: str = "smiles") -> DataFrame:
    return stream.withColumn("safe", safe_encode(smiles))


def tokenized(stream: DataFrame, model: FragmentTokenizer, smiles: str = "smiles") -> DataFrame:
    return model.encode_table(stream, smiles)


def windowed_counts(stream: DataFrame, time: str, window: str, late: str, smiles: str = "smiles") -> DataFrame:
    """start, fragment, n: fragments by event-time window, rows later than ``late`` left out."""
    parts = stream.withWatermark(time, late).select(F.col(time), F.explode(safe_fragments(smiles)).alias("fragment"))
    return parts.groupBy(F.window(time, window), "fragment").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "fragment", "n")
