"""Elements that molecule strings may name."""

from __future__ import annotations

# Symbols by atomic number; 0 is the dummy atom.
SYMBOLS = {
    0: "*", 1: "H", 2: "He", 3: "Li", 4: "Be", 5: "B", 6: "C", 7: "N", 8: "O", 9: "F", 10: "Ne",
    11: "Na", 12: "Mg", 13: "Al", 14: "Si", 15: "P", 16: "S", 17: "Cl", 18: "Ar", 19: "K", 20: "Ca",
    26: "Fe", 29: "Cu", 30: "Zn", 34: "Se", 35: "Br", 53: "I", 92: "U",
}
# Aromatic symbols.
AROMATIC = {"c": 6, "n": 7, "o": 8, "p": 15, "s": 16}
# Valences of neutral atoms; other elements have none.
VALENCE = {1: 1, 5: 3, 6: 4, 7: 3, 8: 2, 9: 1, 14: 4, 15: 3, 16: 2, 17: 1, 35: 1, 53: 1}
# Valences of charged atoms of nitrogen, oxygen, phosphorus and sulphur.
CHARGED = {(7, 1): 4, (7, -1): 2, (8, 1): 3, (8, -1): 1, (15, 1): 4, (16, 1): 3, (16, -1): 1}
# Elements written without brackets.
ORGANIC = frozenset({5, 6, 7, 8, 9, 15, 16, 17, 35, 53})
ORGANIC_AROMATIC = frozenset({5, 6, 7, 8, 15, 16, 34})

NUMBERS = {s: n for n, s in SYMBOLS.items()} | AROMATIC


def valence(element: int, charge: int) -> int:
    """Bonds an atom makes: charges shift it, but for N, O, P and S only as listed."""
    if element in (7, 8, 15, 16):
        return CHARGED.get((element, charge), VALENCE[element])
    return max(0, VALENCE.get(element, 0) - charge) if element else 0
