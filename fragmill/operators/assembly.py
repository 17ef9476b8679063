"""Assembly of encoded strings in built-in expressions: ring numbers, labels, renumbering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring_numbers(smiles: Column) -> Column:
    """array<int>: ring-closure numbers outside bracket atoms, as written."""
    bare = F.regexp_replace(smiles, r"\[.*?\]", "")
    return F.transform(F.regexp_extract_all(bare, F.lit(r"%[0-9][0-9]|[0-9]"), F.lit(0)), lambda x: F.replace(x, F.lit("%"), F.lit("")).cast("int"))


def attachment_labels(scaffold: Column) -> Column:
    """Distinct labelled dummies in binary order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(scaffold, F.lit(r"\[[0-9]+\*\]"), F.lit(0))))


def first_number(scaffold: Column, smiles: Column) -> Column:
    """One more than any ring number of either string; 1 if there is none."""
    return F.coalesce(F.array_max(F.concat(ring_numbers(scaffold), ring_numbers(smiles))) + 1, F.lit(1))


def renumber(scaffold: Column, smiles: Column) -> Column:
    """Replace labels by consecutive ring numbers."""
    first = first_number(scaffold, smiles)
    named = F.transform(attachment_labels(scaffold), lambda x, i: F.struct(x.alias("label"), (first + i).alias("n")))
    return F.aggregate(named, scaffold, lambda acc, x: F.replace(acc, x["label"], F.when(x["n"] < 10, x["n"].cast("string")).otherwise(F.concat(F.lit("%"), x["n"].cast("string")))))


def unwrap(text: Column) -> Column:
    """Take ring numbers, with or without a bond, out of their parentheses."""
    return F.regexp_replace(F.regexp_replace(text, r"\(([%0-9]*)\)", "$1"), r"\(([=\-@#/\\]{0,2})(%?[0-9]{1,2})\)", "$1$2")


def assemble(scaffold: Column, smiles: Column) -> Column:
    """The encoded string of a scaffold; one without cuts stays as it is."""
    labelled = F.size(attachment_labels(scaffold)) > 0
    cut = labelled & (F.size(F.split(scaffold, r"\.")) > 0)
    return F.when(cut, unwrap(renumber(scaffold, smiles))).otherwise(scaffold)
