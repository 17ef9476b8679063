"""The fused kernel: molecule string -> ranked fragments joined by ring numbers."""

from __future__ import annotations

import re

from fragmill.functions import cleavage
from fragmill.functions.graph import Molecule, parse
from fragmill.functions.writer import write

_BRACKET = re.compile(r"\[.*?\]")
_NUMBER = re.compile(r"%([0-9]{2})|([0-9])")
_ATTACHED = re.compile(r"\[[0-9]+\*\]")
_LONE = re.compile(r"\(([%0-9]*)\)")
_BONDED = re.compile(r"\(([=\-@#/\\]{0,2})(%?[0-9]{1,2})\)")


class InvalidSmiles(ValueError):
    def __init__(self, smiles: str):
        super().__init__(f"Invalid SMILES: {smiles}")


def ring_numbers(smiles: str) -> list[int]:
    """Ring-closure numbers in the order written, outside bracket atoms."""
    return [int(a or b) for a, b in _NUMBER.findall(_BRACKET.sub("", smiles))]


def scaffold(m: Molecule) -> tuple[str, int]:
    """Fragments with labelled dummies joined by dots, and the number of cuts."""
    dummies = [a for a in range(len(m)) if not m.element[a]]
    for i, a in enumerate(dummies, 1):
        m.atom_map[a], m.isotope[a] = 0, i
    bonds = cleavage.cuts(m)
    if not bonds:
        return write(m), 0
    parts = cleavage.components(cleavage.cleave(m, bonds, range(len(dummies) + 1, len(dummies) + 1 + len(bonds))))
    parts.sort(key=len, reverse=True)
    return ".".join(write(p, next((a for a in range(len(p)) if p.element[a]), None)) for p in parts), len(bonds)


def number(scaffold_text: str, smiles: str) -> str:
    """Labelled dummies become ring numbers beyond all that either string uses."""
    first = max([0, *ring_numbers(scaffold_text), *ring_numbers(smiles)]) + 1
    out = scaffold_text
    for n, label in enumerate(sorted(set(_ATTACHED.findall(scaffold_text))), first):
        out = out.replace(label, str(n) if n < 10 else f"%{n}")
    return _BONDED.sub(r"\1\2", _LONE.sub(r"\1", out))


def encode(smiles: str) -> str:
    """The encoded string; InvalidSmiles where the input is no molecule."""
    try:
        m = parse(smiles)
        if m is None:
            raise InvalidSmiles(smiles)
        text, n = scaffold(m)
    except (IndexError, KeyError) as e:
        raise InvalidSmiles(smiles) from e
    return number(text, smiles) if n else text


def encode_or_none(smiles: str | None) -> str | None:
    """None for null and for what is no molecule (degenerate chirality included)."""
    if smiles is None:
        return None
    try:
        return encode(smiles)
    except ValueError:
        return None


def fragments(smiles: str | None) -> list[str] | None:
    """Fragments of a molecule; what is no molecule is one fragment as a whole."""
    if smiles is None:
        return None
    text = encode_or_none(smiles)
    return [smiles] if text is None else text.split(".")
