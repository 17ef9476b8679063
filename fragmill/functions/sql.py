"""SQL names for the kernel: safe_encode, is_valid_smiles, write_smiles and the table function explode_fragments."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fragmill.functions import columns, safe


class _ExplodeFragments:
    def eval(self, smiles: str):
        for pos, fragment in enumerate(safe.fragments(smiles) or []):
            yield pos, fragment


def register(spark: SparkSession) -> None:
    spark.udf.register("safe_encode", columns._encode)
    spark.udf.register("is_valid_smiles", columns._valid)
    spark.udf.register("write_smiles", columns._written)
    spark.udtf.register("explode_fragments", F.udtf(_ExplodeFragments, returnType="pos int, fragment string"))
