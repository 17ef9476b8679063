"""Atoms, bonds and cuts as tables.

``atoms`` and ``bonds`` explode the parsed struct; ``cut_bonds`` picks the bonds to cut with
built-in expressions only: the rule table is a literal, so nothing is joined or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.functions import cleavage
from fragmill.functions.columns import parse_smiles
from fragmill.functions.graph import AROMATIC, DOUBLE, SINGLE


def parsed(df: DataFrame, smiles: str = "smiles", to: str = "molecule") -> DataFrame:
    return df.withColumn(to, parse_smiles(smiles))


def per_string(df: DataFrame, add: Callable[[DataFrame], DataFrame], smiles: str = "smiles") -> DataFrame:
    """``add`` applied to the distinct strings, joined to all rows: the kernel sees a string once.

    Rows with a null string keep null results.
    """
    strings = df.where(F.col(smiles).isNotNull()).select(smiles).distinct()
    return df.join(add(strings), smiles, "left")


def atoms(df: DataFrame, *keys: str, molecule: str = "molecule") -> DataFrame:
    return df.select(*keys, F.posexplode(f"{molecule}.atoms").alias("atom", "a")).select(*keys, "atom", "a.*")


def bonds(df: DataFrame, *keys: str, molecule: str = "molecule") -> DataFrame:
    return df.select(*keys, F.posexplode(f"{molecule}.bonds").alias("bond", "b")).select(*keys, "bond", "b.*")


def rules(spark: SparkSession) -> DataFrame:
    """The rule table: left, right (environments), double."""
    return spark.createDataFrame(cleavage.rules(), "left_env string, right_env string, double boolean")


def in_environment(mask: Column, name: str) -> Column:
    return mask.bitwiseAND(cleavage.BIT[name]) != 0


def _table() -> Column:
    return F.array(*[F.struct(F.lit(a).alias("left_env"), F.lit(b).alias("right_env"), F.lit(cleavage.BIT[a]).alias("l"), F.lit(cleavage.BIT[b]).alias("r"), F.lit(d).alias("d")) for a, b, d in cleavage.rules()])


def _fits(molecule: Column, b: Column) -> Callable[[Column], Column]:
    """Does a rule name the ends of bond ``b``?"""
    left = F.element_at(molecule["atoms"], b["a"] + 1)["environments"]
    right = F.element_at(molecule["atoms"], b["b"] + 1)["environments"]

    def rule(r: Column) -> Column:
        kind = F.when(r["d"], b["kind"] == DOUBLE).otherwise(b["kind"].isin(SINGLE, AROMATIC))
        fits = lambda x, y: (x.bitwiseAND(r["l"]) != 0) & (y.bitwiseAND(r["r"]) != 0)
        return ~b["in_ring"] & kind & (fits(left, right) | fits(right, left))

    return rule


def cut_bonds(molecule: Column) -> Column:
    """array<int>: positions of the bonds to cut."""
    numbered = F.transform(molecule["bonds"], lambda b, i: F.when(F.exists(_table(), _fits(molecule, b)), i))
    return F.filter(numbered, lambda i: i.isNotNull())


def rule_hits(molecule: Column) -> Column:
    """array<struct<left_env, right_env, ...>>: every rule that names a bond, for every bond."""
    return F.flatten(F.transform(molecule["bonds"], lambda b: F.filter(_table(), _fits(molecule, b))))
