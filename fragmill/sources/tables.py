"""Molecule strings in, results out."""

from __future__ import annotations

import itertools
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.sources.shared import shared_file


def from_list(spark: SparkSession, smiles: list[str | None]) -> DataFrame:
    """mol_id, smiles in the order of the list."""
    return spark.createDataFrame(list(enumerate(smiles)), "mol_id long, smiles string")


def from_iterator(spark: SparkSession, items: Iterable[str], buffer_size: int = 8192) -> DataFrame:
    """mol_id, smiles of a bounded Python iterator; an item that is no string is an error.

    The driver holds ``buffer_size`` items: each buffer is written to the shared folder before the next is read.
    """
    if buffer_size < 1:
        raise ValueError("buffer_size is at least 1")
    schema = "mol_id long, smiles string"
    path = shared_file(spark, "items")
    taken = iter(items)
    spark.createDataFrame([], schema).write.parquet(path)
    at = 0
    while buffer := list(itertools.islice(taken, buffer_size)):
        for i, item in enumerate(buffer, at):
            if not isinstance(item, str):
                raise TypeError(f"item {i} is no string")
        table = pa.table({"mol_id": pa.array(range(at, at + len(buffer)), pa.int64()), "smiles": pa.array(buffer, pa.string())})
        spark.createDataFrame(table).write.mode("append").parquet(path)
        at += len(buffer)
    return spark.read.schema(schema).parquet(path)


def from_csv(spark: SparkSession, path: str) -> DataFrame:
    """smiles: the first column of CSV files with a header, without nulls and empty values."""
    rows = spark.read.csv(path, header=True)
    first = F.col(f"`{rows.columns[0]}`")
    return rows.select(first.alias("smiles")).where(first.isNotNull() & (first != ""))


def first_rows(df: DataFrame, n: int, order: str = "mol_id") -> DataFrame:
    """The first n rows in the given order."""
    return df.orderBy(order).limit(n)


def to_numpy(df: DataFrame, ids: str = "ids", order: str = "mol_id") -> np.ndarray:
    """A padded batch as (rows, length) of uint32; the batch must fit the driver."""
    rows = [r[ids] for r in df.select(ids, order).orderBy(order).collect()]
    return np.array(rows, np.uint32) if rows else np.zeros((0, 0), np.uint32)


def write_failures(df: DataFrame, path: str) -> None:
    """input, decoded as CSV with a header."""
    df.select("input", "decoded").write.mode("overwrite").csv(path, header=True)
