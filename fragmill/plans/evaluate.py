"""Round-trip evaluation of a tokenizer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.functions.columns import is_valid_smiles
from fragmill.operators.isomorphism import same_molecules
from fragmill.operators.molecules import per_string
from fragmill.plans.model import FragmentTokenizer
from fragmill.sources.shared import checkpointed


def round_trips(df: DataFrame, model: FragmentTokenizer, smiles: str = "smiles", shuffle: bool = False, reader: FragmentTokenizer | None = None, compare: str = "strings") -> DataFrame:
    """Add ids, expected, decoded and ok: is the decoded string the encoded one (its fragments, if shuffled)?

    The kernel runs once for each distinct string.  ``reader`` decodes, if it is not the model itself.
    ``compare``: "molecules" asks instead whether the decoded string is the molecule that went in, found
    by its graph (operators.isomorphism); strings that are no molecules go in as they are and are compared as strings.
    """
    if compare not in ("strings", "molecules"):
        raise ValueError(f"compare is strings or molecules, not {compare}")

    def tested(strings: DataFrame) -> DataFrame:
        out = model.encode_table(strings, smiles, "ids", shuffle=shuffle, seed=0 if shuffle else None, fragments_to="_parts")
        out = out.withColumn("decoded", (reader or model).decoded(F.col("ids"))).withColumn("expected", F.coalesce(F.array_join("_parts", "."), F.col(smiles)))
        same = F.array_sort(F.split("decoded", r"\.")) == F.array_sort(F.split("expected", r"\."))
        out = out.withColumn("ok", same if shuffle else F.col("decoded") == F.col("expected")).drop("_parts")
        if compare == "strings":
            return out
        out = same_molecules(out.withColumn("_valid", is_valid_smiles(smiles)), smiles, "decoded", "_same")
        return out.withColumn("ok", F.when(F.col("_valid"), F.coalesce("_same", F.lit(False))).otherwise(F.col("ok"))).drop("_valid", "_same")

    return per_string(df, tested, smiles)


def accuracy(tested: DataFrame) -> DataFrame:
    """n, n_ok, accuracy."""
    ok = F.col("ok").cast("int")
    return tested.agg(F.count("*").alias("n"), F.coalesce(F.sum(ok), F.lit(0)).alias("n_ok"), F.avg(ok).alias("accuracy"))


def failures(tested: DataFrame, smiles: str = "smiles") -> DataFrame:
    return tested.where(~F.col("ok")).select(F.col(smiles).alias("input"), "decoded")


def first_failures(tested: DataFrame, order: str, n: int = 10, smiles: str = "smiles") -> DataFrame:
    """The first ``n`` failures in the given order, as the command line prints them."""
    return tested.where(~F.col("ok")).orderBy(order).limit(n).select(F.col(order), F.col(smiles).alias("input"), "decoded")


def run_tested(train: DataFrame, test: DataFrame, vocab_size: int = 1000, shuffle: bool = False, failures_path: str | None = None, compare: str = "molecules") -> tuple[DataFrame, DataFrame]:
    """Train and test; write failures as CSV if asked to.  Returns the accuracy table and the tested rows."""
    from fragmill.plans.trainer import BpeTrainer

    tested = checkpointed(round_trips(test, BpeTrainer(vocab_size).fit(train), shuffle=shuffle, compare=compare))
    if failures_path:
        from fragmill.sources.tables import write_failures

        write_failures(failures(tested), failures_path)
    return accuracy(tested), tested


def run(train: DataFrame, test: DataFrame, vocab_size: int = 1000, shuffle: bool = False, failures_path: str | None = None, compare: str = "molecules") -> DataFrame:
    """The accuracy table of ``run_tested``."""
    return run_tested(train, test, vocab_size, shuffle, failures_path, compare)[0]
