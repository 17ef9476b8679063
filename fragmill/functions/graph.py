"""Molecule graphs as columns of atoms and bonds, read from strings.

A lexer (one regular expression) gives tokens; a stack machine over them fills the columns.
Then chirality marks are turned from the order of writing to the order of bonds, rings are
found as the bonds that are no bridges, and hydrogens are counted on a kekulised copy.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from fragmill.functions.elements import NUMBERS, SYMBOLS, valence

SINGLE, DOUBLE, TRIPLE, AROMATIC = 1, 2, 3, 4
#: In lists of neighbours: the hydrogen of a bracket atom.
HYDROGEN = -1
_OPEN = -2  # a ring bond whose other end is still unknown

_TWO = "|".join(sorted(s for s in SYMBOLS.values() if len(s) == 2))
_ONE = "".join(s for s in NUMBERS if len(s) == 1 and s != "*")
TOKEN = re.compile(
    rf"""\[(?P<isotope>[0-9]*)(?P<symbol>{_TWO}|[{_ONE}*])(?P<chiral>@{{0,2}})(?P<h>H[0-9]?)?(?P<charge>(?P<sign>[+-])(?:[0-9]|(?P=sign))*)?(?P<map>:[0-9]*)?\]
    |(?P<atom>Br|Cl|Si|Se|[BCNOPSFIcnosp*])
    |(?P<bond>[-=\#:/\\])
    |%(?P<ring2>[0-9]{{2}})|(?P<ring>[0-9])
    |(?P<other>[().])""",
    re.X,
)
_ORDER = {"-": SINGLE, "=": DOUBLE, "#": TRIPLE, ":": AROMATIC, "/": SINGLE, "\\": SINGLE}
_STEREO = {"/": 1, "\\": -1}


@dataclass
class Molecule:
    """Atoms and bonds by column.  ``near[a]``: (neighbour, bond) in the order of bonds."""

    element: list[int] = field(default_factory=list)
    charge: list[int] = field(default_factory=list)
    isotope: list[int] = field(default_factory=list)
    atom_map: list[int] = field(default_factory=list)
    aromatic: list[bool] = field(default_factory=list)
    chiral: list[int] = field(default_factory=list)  # 1: "@", 2: "@@"
    written_h: list[int] = field(default_factory=list)
    implied_h: list[int] = field(default_factory=list)
    bracket: list[bool] = field(default_factory=list)
    near: list[list[tuple[int, int]]] = field(default_factory=list)
    ends: list[tuple[int, int]] = field(default_factory=list)
    order: list[int] = field(default_factory=list)
    stereo: list[int] = field(default_factory=list)  # 1: "/", -1: "\\", seen from the first end
    ring: list[bool] = field(default_factory=list)

    def atom(self, element, charge=0, isotope=0, atom_map=0, aromatic=False, chiral=0, written_h=0, implied_h=0, bracket=False) -> int:
        for column, value in zip((self.element, self.charge, self.isotope, self.atom_map, self.aromatic, self.chiral, self.written_h, self.implied_h, self.bracket), (element, charge, isotope, atom_map, aromatic, chiral, written_h, implied_h, bracket)):
            column.append(value)
        self.near.append([])
        return len(self.element) - 1

    def copy_atom(self, other: Molecule, a: int) -> int:
        return self.atom(other.element[a], other.charge[a], other.isotope[a], other.atom_map[a], other.aromatic[a], other.chiral[a], other.written_h[a], other.implied_h[a], other.bracket[a])

    def bond(self, a: int, b: int, order: int, stereo: int = 0, ring: bool = False) -> int:
        self.ends.append((a, b))
        self.order.append(order)
        self.stereo.append(stereo)
        self.ring.append(ring)
        k = len(self.ends) - 1
        self.near[a].append((b, k))
        self.near[b].append((a, k))
        return k

    def __len__(self) -> int:
        return len(self.element)

    def in_ring(self, a: int) -> bool:
        return any(self.ring[k] for _, k in self.near[a])

    def order_sum(self, a: int) -> int:
        """Orders of the bonds of an atom; aromatic ones count once."""
        return sum(1 if self.order[k] == AROMATIC else self.order[k] for _, k in self.near[a])


def swaps(order: list[int], other: list[int]) -> int:
    """Selection swaps that bring ``other`` into ``order``; raises ValueError if they differ in content."""
    rest, n = list(other), 0
    for i, want in enumerate(order):
        if rest[i] != want:
            j = rest.index(want, i + 1)
            rest[i], rest[j] = rest[j], rest[i]
            n += 1
    return n


def parse(smiles: str) -> Molecule | None:
    """The molecule, or None where the string is none."""
    m = Molecule()
    stack: list[int] = []
    rings: dict[int, tuple[int, int | None, int]] = {}
    seats: dict[int, tuple[int, int]] = {}
    said: dict[int, list[int]] = {}  # chiral atom -> neighbours as written
    order: int | None = None
    stereo = 0
    at = 0

    def kind(a: int, b: int, given: int | None) -> int:
        return given if given is not None else AROMATIC if m.aromatic[a] and m.aromatic[b] else SINGLE

    while at < len(smiles):
        t = TOKEN.match(smiles, at)
        if not t:
            return None
        at = t.end()
        if t["bond"]:
            order = _ORDER[t["bond"]]
            stereo = _STEREO.get(t["bond"], stereo)
        elif t["other"]:
            if t["other"] == "(":
                stack += stack[-1:]
            elif t["other"] == ")":
                stack[-1:] = []
            else:
                stack, order, stereo = [], None, 0
        elif t["ring"] or t["ring2"]:
            if not stack:
                return None
            number, here = int(t["ring"] or t["ring2"]), stack[-1]
            if number in rings:
                there, first, turned = rings.pop(number)
                m.bond(there, here, kind(there, here, order if order is not None else first), -stereo or turned)
                if here in said:
                    said[here].append(there)
                if number in seats:
                    a, seat = seats.pop(number)
                    said[a][seat] = here
            else:
                rings[number] = here, order, stereo
                if here in said:
                    seats[number] = here, len(said[here])
                    said[here].append(_OPEN)
            order, stereo = None, 0
        else:
            if t["atom"]:
                a = m.atom(NUMBERS[t["atom"]], aromatic=t["atom"].islower(), implied_h=-1)
            else:
                charge = 0
                if t["charge"]:
                    for c in t["charge"][1:]:
                        charge = charge * 10 + int(c) if c.isdigit() else charge + 1 if charge else 2
                    charge = (charge or 1) * (1 if t["sign"] == "+" else -1)
                h = int(t["h"][1:] or 1) if t["h"] else 0
                a = m.atom(NUMBERS[t["symbol"]], charge, int(t["isotope"] or 0), int((t["map"] or ":")[1:] or 0), t["symbol"].islower(), len(t["chiral"]), h, 0, True)
                if t["chiral"]:
                    said[a] = []
            if stack:
                before = stack.pop()
                m.bond(before, a, kind(before, a, order), stereo)
                if before in said:
                    said[before].append(a)
                if a in said:
                    said[a].append(before)
            if a in said and m.written_h[a]:
                said[a].append(HYDROGEN)
            stack.append(a)
            order, stereo = None, 0
    if len(stack) > 1 or rings:
        return None
    for a, wrote in said.items():
        bonds = [HYDROGEN] * (HYDROGEN in wrote) + [b for b, _ in m.near[a]]
        if wrote and len(wrote) == len(bonds) and swaps(bonds, wrote) % 2:
            m.chiral[a] = 3 - m.chiral[a]
    find_rings(m)
    imply_hydrogens(m)
    return m


def find_rings(m: Molecule) -> None:
    """Ring bonds are those that are neither bridges nor loops (low points of a depth-first search)."""
    entered: dict[int, int] = {}
    low: dict[int, int] = {}
    m.ring = [a != b for a, b in m.ends]
    for start in range(len(m)):
        if start in entered:
            continue
        entered[start] = low[start] = len(entered)
        path = [(start, -1, iter(m.near[start]))]
        while path:
            a, by, rest = path[-1]
            for b, k in rest:
                if k == by:
                    continue
                if b in entered:
                    low[a] = min(low[a], entered[b])
                else:
                    entered[b] = low[b] = len(entered)
                    path.append((b, k, iter(m.near[b])))
                    break
            else:
                path.pop()
                if path:
                    above = path[-1][0]
                    low[above] = min(low[above], low[a])
                    if low[a] > entered[above]:
                        m.ring[by] = False


def kekule_orders(m: Molecule) -> list[int]:
    """Bond orders with aromatic bonds turned single or double.

    Atoms short of their valence are paired greedily in atom order, then along augmenting
    paths; only the neighbours tried are marked, so in an odd ring a path may come back to
    where it began.  That is part of the definition: hydrogen counts, and ranks, follow from it.
    """
    order = [SINGLE if o == AROMATIC else o for o in m.order]
    if AROMATIC not in m.order:
        return order
    soft = [[(b, k) for b, k in m.near[a] if m.order[k] == AROMATIC] for a in range(len(m))]
    short = [m.aromatic[a] and sum(order[k] for _, k in m.near[a]) + m.written_h[a] < valence(m.element[a], m.charge[a]) for a in range(len(m))]
    mate: dict[int, int] = {}
    for a in range(len(m)):
        if short[a] and a not in mate:
            for b, k in soft[a]:
                if short[b] and b not in mate:
                    mate[a], mate[b] = b, a
                    order[k] = DOUBLE
                    break
    again = True
    while again:
        again = False
        for a in range(len(m)):
            if short[a] and a not in mate and _augment(m, a, soft, short, mate, order):
                again = True
    return order


def _augment(m: Molecule, start: int, soft, short, mate: dict[int, int], order: list[int]) -> bool:
    tried: set[int] = set()
    path = [(start, iter(soft[start]))]
    steps: list[tuple[int, int, int]] = []
    while path:
        a, rest = path[-1]
        for b, k in rest:
            if b in tried or not short[b]:
                continue
            tried.add(b)
            steps.append((a, b, k))
            if b in mate:
                path.append((mate[b], iter(soft[mate[b]])))
                break
            for u, v, bond in reversed(steps):
                if v in mate:
                    old = next((j for w, j in soft[v] if order[j] == DOUBLE and w == mate[v]), None)
                    if old is not None:
                        order[old] = SINGLE
                mate[u], mate[v] = v, u
                order[bond] = DOUBLE
            return True
        else:
            path.pop()
            if steps:
                steps.pop()
    return False


def imply_hydrogens(m: Molecule) -> None:
    order = kekule_orders(m)
    for a in range(len(m)):
        if not m.bracket[a]:
            used = sum(order[k] for _, k in m.near[a]) + m.written_h[a]
            m.implied_h[a] = max(0, valence(m.element[a], m.charge[a]) - used) if m.element[a] else 0
