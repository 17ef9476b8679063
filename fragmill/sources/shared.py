"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="fragmill-checkpoint-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def shared_file(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/fragmill/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The table written once to the shared folder; its lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that nothing reads any more."""
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
