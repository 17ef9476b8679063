"""Column API of the molecule kernel: Arrow-batched functions, one Python pass each."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fragmill.functions import cleavage, graph, safe


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_INT, _BOOL = T.IntegerType(), T.BooleanType()
ATOM = _struct(element=_INT, charge=_INT, isotope=_INT, atom_map=_INT, aromatic=_BOOL, chiral=_INT, written_h=_INT, implied_h=_INT, bracket=_BOOL, in_ring=_BOOL, degree=_INT, order_sum=_INT, environments=_INT)
BOND = _struct(a=_INT, b=_INT, kind=_INT, stereo=_INT, in_ring=_BOOL)
MOLECULE = _struct(atoms=T.ArrayType(ATOM), bonds=T.ArrayType(BOND))


def _each(s: pd.Series, f) -> pd.Series:
    """``f`` of each string; one that an Arrow batch holds several times goes through ``f`` once."""
    codes, strings = pd.factorize(s)
    out = [*map(f, strings), f(None)]  # nulls have the code -1
    return pd.Series([out[i] for i in codes], dtype=object)


@F.pandas_udf(T.StringType())
def _encode(s: pd.Series) -> pd.Series:
    return _each(s, safe.encode_or_none)


def safe_encode(smiles: Column | str, strict: bool = False) -> Column:
    """The encoded string; null for what is no molecule, or an error if ``strict``."""
    col = F.col(smiles) if isinstance(smiles, str) else smiles
    out = _encode(col)
    if not strict:
        return out
    return F.when(out.isNull() & col.isNotNull(), F.raise_error(F.concat(F.lit("Invalid SMILES: "), col)).cast("string")).otherwise(out)


def safe_fragments(smiles: Column | str) -> Column:
    """Fragments; a string that is no molecule is one fragment, its dots included."""
    col = F.col(smiles) if isinstance(smiles, str) else smiles
    return F.when(col.isNotNull(), F.coalesce(F.split(_encode(col), r"\."), F.array(col)))


def as_struct(m: graph.Molecule) -> dict:
    masks = cleavage.environments(m)
    atoms = [
        dict(element=m.element[a], charge=m.charge[a], isotope=m.isotope[a], atom_map=m.atom_map[a], aromatic=m.aromatic[a], chiral=m.chiral[a], written_h=m.written_h[a], implied_h=m.implied_h[a], bracket=m.bracket[a], in_ring=m.in_ring(a), degree=len(m.near[a]), order_sum=m.order_sum(a), environments=masks[a])
        for a in range(len(m))
    ]
    return {"atoms": atoms, "bonds": [dict(a=a, b=b, kind=m.order[k], stereo=m.stereo[k], in_ring=m.ring[k]) for k, (a, b) in enumerate(m.ends)]}


def _parsed(text: str | None) -> graph.Molecule | None:
    try:
        return None if text is None else graph.parse(text)
    except (ValueError, IndexError, KeyError):
        return None


@F.udf(MOLECULE, useArrow=True)
def _molecule(text):
    m = _parsed(text)
    return None if m is None else as_struct(m)


_molecule_once = F.udf(_molecule.func, MOLECULE, useArrow=True).asNondeterministic()


def parse_smiles(smiles: Column | str, once: bool = False) -> Column:
    """Atoms and bonds as a struct of arrays of structs; null for what is no molecule.

    ``once``: the optimiser may not copy the call into each expression that reads its result.
    """
    return (_molecule_once if once else _molecule)(F.col(smiles) if isinstance(smiles, str) else smiles)


@F.pandas_udf(T.BooleanType())
def _valid(s: pd.Series) -> pd.Series:
    return _each(s, lambda t: None if t is None else _parsed(t) is not None)


def is_valid_smiles(smiles: Column | str) -> Column:
    return _valid(F.col(smiles) if isinstance(smiles, str) else smiles)


@F.pandas_udf(T.StringType())
def _scaffold(s: pd.Series) -> pd.Series:
    def one(text):
        m = _parsed(text)
        return None if m is None else safe.scaffold(m)[0]

    return _each(s, one)


def scaffold(smiles: Column | str) -> Column:
    """Fragments with labelled dummies, before ring numbers replace the labels."""
    return _scaffold(F.col(smiles) if isinstance(smiles, str) else smiles)


@F.pandas_udf(T.StringType())
def _written(s: pd.Series) -> pd.Series:
    from fragmill.functions.writer import write

    def one(text):
        m = _parsed(text)
        return None if m is None else write(m)

    return _each(s, one)


def write_smiles(smiles: Column | str) -> Column:
    """The ranked string of the molecule, uncut."""
    return _written(F.col(smiles) if isinstance(smiles, str) else smiles)
