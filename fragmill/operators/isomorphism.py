"""Are two parsed molecules the same?  Colour refinement inside each row, in built-in array functions.

``labelled`` colours the atoms of a molecule (``functions.columns.MOLECULE``): by what they are, then round by
round by their own colour and those of their neighbours, until no class splits.  Marks then become invariants:
a centre whose neighbours all differ in colour takes its parity in the order of colours, a double bond
whose ends can be told apart takes which sides its marked neighbours are on; and colours are refined again.  What
still shares a colour is told apart one atom at a time, the first of the smallest class each time.  The result is
``stable``, the sorted colours before atoms were told apart, which depend on the molecule alone, and ``form``, its
atoms and bonds by rank of colour.  Each round splits a class or ends, so there are at most n + 3.

``compared``: other stable colours, other molecules; equal forms, the same one, whatever hashes did.  Only what is
left, where the order of telling apart mattered, is searched for a renumbering: exact backtracking inside colour
classes, in Arrow batches that get null for every other row.

Compared are element, charge, isotope, hydrogens (written and implied alike), aromaticity as written, bonds, parity of
marked atoms and sides of marked double bonds.  Not compared: atom maps, brackets, the order of atoms.  An aromatic
bond outside rings is single, as between two rings that a closure joins.  Kekule and aromatic forms aren't
brought together: the encoder keeps what it reads.

Defined results: null where either molecule is null; two empty molecules are the same; components in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fragmill.functions.columns import MOLECULE, parse_smiles
from fragmill.functions.graph import AROMATIC, DOUBLE, SINGLE

#: A mark that the colours can't tell a side of (yet).
_OPEN = 9


def _let(value: Column, body) -> Column:
    """Bind an expression, so that lambdas read it instead of evaluating it again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _kind(b: Column) -> Column:
    return F.when((b["kind"] == AROMATIC) & ~b["in_ring"], SINGLE).otherwise(b["kind"])


def _features(a: Column) -> Column:
    """What an atom is, without its place."""
    h = a["written_h"] + F.greatest(a["implied_h"], F.lit(0))
    return F.struct(a["element"].alias("z"), a["charge"].alias("q"), a["isotope"].alias("iso"), h.alias("h"), a["aromatic"].alias("ar"), (a["chiral"] > 0).alias("marked"))


def _near(atoms: Column, bonds: Column) -> Column:
    """For each atom its entries (bond, other end, kind, side), by bond; the first is the atom itself, by bond -1.

    side: 1 where the other end is above, -1 below, 0 unmarked.
    """
    entry = lambda a, k, b, kind, side: F.struct(a.cast("int").alias("a"), k.cast("int").alias("k"), b.cast("int").alias("b"), kind.cast("int").alias("kind"), side.cast("int").alias("side"))
    own = F.transform(atoms, lambda x, i: entry(i, F.lit(-1), i, F.lit(0), F.lit(0)))
    there = F.transform(bonds, lambda b, k: entry(b["a"], k, b["b"], _kind(b), b["stereo"]))
    back = F.transform(bonds, lambda b, k: entry(b["b"], k, b["a"], _kind(b), -b["stereo"]))

    def split(e: Column) -> Column:
        starts = F.filter(F.transform(e, lambda x, i: F.when(x["k"] == -1, i)), lambda i: i.isNotNull())
        return _let(starts, lambda s: F.transform(s, lambda at, i: F.slice(e, at + 1, F.coalesce(F.get(s, i + 1), F.size(e)) - at)))

    return _let(F.array_sort(F.concat(own, there, back)), split)


def _refined(near: Column, c: Column) -> Column:
    return F.transform(near, lambda es: F.xxhash64(F.sort_array(F.transform(es, lambda e: F.xxhash64(e["kind"], F.get(c, e["b"]))))))


def _parity(chiral: Column, es: Column, c: Column) -> Column:
    """0 unmarked, 1 or 2 by the order of the neighbours' colours, _OPEN where two are equal."""
    seen = F.transform(F.filter(es, lambda e: e["k"] >= 0), lambda e: F.get(c, e["b"]))

    def turned(s: Column) -> Column:
        swaps = F.aggregate(F.transform(s, lambda x, i: F.size(F.filter(s, lambda y, j: (j < i) & (y > x)))), F.lit(0), lambda n, x: n + x)
        return F.when(F.size(F.array_distinct(s)) < F.size(s), _OPEN).otherwise(1 + F.pmod(chiral - 1 + swaps, F.lit(2)))

    return F.when(chiral == 0, 0).otherwise(_let(seen, turned))


def _side(es: Column, k: Column, c: Column) -> Column:
    """Where the neighbour with the highest colour is at one end of bond ``k``: 1, -1, 0 unmarked, _OPEN where two are equal."""
    others = F.transform(F.filter(es, lambda e: (e["k"] >= 0) & (e["k"] != k)), lambda e: F.struct(F.get(c, e["b"]).alias("c"), e["side"].alias("side")))

    def told(s: Column) -> Column:
        top = F.get(F.sort_array(s, False), 0)
        marked = F.get(F.filter(s, lambda x: x["side"] != 0), 0)
        equal = F.size(F.array_distinct(F.transform(s, lambda x: x["c"]))) < F.size(s)
        return F.when(marked.isNull(), 0).when(equal, _OPEN).otherwise(F.when(top["c"] == marked["c"], marked["side"]).otherwise(-marked["side"]))

    return _let(others, told)


def _bond_marks(bonds: Column, near: Column, c: Column) -> Column:
    """For each bond 0 (no double bond, or an end unmarked), 1 one side, 2 opposite sides, _OPEN."""

    def mark(b: Column, k: Column) -> Column:
        ends = F.struct(_side(F.get(near, b["a"]), k, c).alias("x"), _side(F.get(near, b["b"]), k, c).alias("y"))
        both = lambda s: F.when((s["x"] == 0) | (s["y"] == 0), 0).when((s["x"] == _OPEN) | (s["y"] == _OPEN), _OPEN).when(s["x"] == s["y"], 1).otherwise(2)
        return F.when(b["kind"] == DOUBLE, _let(ends, both)).otherwise(0)

    return F.transform(bonds, mark)


def _marked(atoms: Column, bonds: Column, near: Column, c: Column) -> Column:
    """Colours with what the marks tell."""
    own = lambda m: F.transform(near, lambda es, i: F.xxhash64(F.get(c, i), _parity(F.get(atoms, i)["chiral"], es, c), F.sort_array(F.transform(F.filter(es, lambda e: e["k"] >= 0), lambda e: F.xxhash64(F.get(m, e["k"]), F.get(c, e["b"]))))))
    return _let(_bond_marks(bonds, near, c), own)


def _apart(c: Column) -> Column:
    """The first atom of the smallest colour that several have gets a colour of its own."""

    def chosen(s: Column) -> Column:
        shared = F.get(F.filter(s, lambda x, i: x == F.get(s, i + 1)), 0)
        at = F.array_position(c, shared) - 1
        return _let(at, lambda k: F.transform(c, lambda x, i: F.when(i == k, F.xxhash64(x, F.lit("apart"))).otherwise(x)))

    return _let(F.sort_array(c), chosen)


def _colours(atoms: Column, bonds: Column, near: Column) -> Column:
    """struct<c, stable>: a colour of its own for each atom, and the sequence of colours before atoms were told apart."""
    state = lambda c, n, phase, stable: F.struct(c.alias("c"), n.alias("n"), phase.alias("phase"), stable.alias("stable"))
    none = F.lit(None).cast("array<bigint>")
    first = F.transform(atoms, lambda a: F.xxhash64(_features(a)))
    start = _let(first, lambda c: state(c, F.size(F.array_distinct(c)), F.lit(0), none))

    def settled(s: Column) -> Column:
        """No class split: marks next, then atoms told apart, then the end."""
        marks = _let(_marked(atoms, bonds, near, s["c"]), lambda c: state(c, F.size(F.array_distinct(c)), F.lit(1), none))
        stable = F.coalesce(s["stable"], s["c"])
        apart = state(_apart(s["c"]), s["n"] + 1, F.lit(2), stable)
        return F.when(s["phase"] == 0, marks).when(s["n"] < F.size(atoms), apart).otherwise(state(s["c"], s["n"], F.lit(3), stable))

    def step(s: Column, _: Column) -> Column:
        def grown(c: Column) -> Column:
            return _let(F.size(F.array_distinct(c)), lambda n: F.when(n > s["n"], state(c, n, s["phase"], s["stable"])).otherwise(settled(s)))

        return F.when(s["phase"] == 3, s).otherwise(_let(_refined(near, s["c"]), grown))

    return F.aggregate(F.sequence(F.lit(1), F.size(atoms) + 3), start, step, lambda s: F.struct(s["c"].alias("c"), F.coalesce(s["stable"], s["c"]).alias("stable")))


def _form(atoms: Column, bonds: Column, near: Column, c: Column) -> Column:
    """Atoms and bonds by rank, marks included: equal for two molecules only if they are the same."""

    def ranked(r: Column) -> Column:
        at = F.array_sort(F.transform(atoms, lambda a, i: F.struct(F.get(r, i).alias("rank"), _features(a).alias("is"), _parity(a["chiral"], F.get(near, i), r).alias("parity"))))
        ends = lambda b: (F.get(r, b["a"]), F.get(r, b["b"]))
        tied = lambda m: F.array_sort(F.transform(bonds, lambda b, k: F.struct(F.least(*ends(b)).alias("low"), F.greatest(*ends(b)).alias("high"), _kind(b).alias("kind"), F.get(m, k).alias("mark"))))
        return F.struct(at.alias("atoms"), _let(_bond_marks(bonds, near, r), tied).alias("bonds"))

    ranks = lambda s: F.transform(c, lambda x: F.array_position(s, x))
    return _let(_let(F.sort_array(c), ranks), ranked)


def labelled(molecule: Column) -> Column:
    """struct<stable, form, colours>; null for a null molecule.  colours: the stable colour of each atom."""

    def of(m: Column) -> Column:
        atoms, bonds = m["atoms"], m["bonds"]
        built = lambda near: _let(_colours(atoms, bonds, near), lambda x: F.struct(F.sort_array(x["stable"]).alias("stable"), _form(atoms, bonds, near, x["c"]).alias("form"), x["stable"].alias("colours")))
        return _let(_near(atoms, bonds), built)

    return F.when(molecule.isNotNull(), _let(molecule, of))


def _entries(m: dict) -> list[dict[int, tuple[int, int, int]]]:
    """For each atom: bond -> (other end, kind, side), by bond."""
    near: list[dict[int, tuple[int, int, int]]] = [{} for _ in m["atoms"]]
    for k, b in enumerate(m["bonds"]):
        kind = SINGLE if b["kind"] == AROMATIC and not b["in_ring"] else b["kind"]
        near[b["a"]][k] = b["b"], kind, b["stereo"]
        near[b["b"]][k] = b["a"], kind, -b["stereo"]
    return near


def _odd(near: dict[int, tuple[int, int, int]], chiral: int, key) -> int:
    seen = [key[b] for b, _, _ in near.values()]
    return (chiral + sum(y > x for i, x in enumerate(seen) for y in seen[:i])) % 2


def _sides(m: dict, near, key) -> dict[tuple[int, ...], bool]:
    """Ends of each double bond that is marked at both -> are the marked neighbours with the highest keys on one side?"""
    out = {}
    for k, b in enumerate(m["bonds"]):
        if b["kind"] != DOUBLE:
            continue
        found = []
        for end in (b["a"], b["b"]):
            rest = sorted((key[o], side) for j, (o, _, side) in near[end].items() if j != k)
            told = next((side if x == rest[-1][0] else -side for x, side in rest if side), 0)
            found.append(told)
        if all(found):
            out[tuple(sorted((key[b["a"]], key[b["b"]])))] = found[0] == found[1]
    return out


def renumbering(left: dict, right: dict, colours: list[int], others: list[int]) -> list[int] | None:
    """For each atom of ``left`` the atom of ``right`` that it is, marks included; None if there is no such renumbering.

    Atoms are mapped along bonds and within colours; an atom's parity is checked once its neighbours are mapped.
    """
    one, two = _entries(left), _entries(right)
    n = len(one)
    if n != len(two) or len(left["bonds"]) != len(right["bonds"]):
        return None
    places: dict[int, list[int]] = {}
    for i, c in enumerate(others):
        places.setdefault(c, []).append(i)
    order, reached = [], set()
    for root in sorted(range(n), key=lambda i: len(places.get(colours[i], ()))):
        todo = [root]
        while todo:
            a = todo.pop()
            if a not in reached:
                reached.add(a)
                order.append(a)
                todo += [b for b, _, _ in one[a].values()]
    bonds = [sorted((b, kind) for b, kind, _ in x.values()) for x in two]
    to: dict[int, int] = {}
    taken: set[int] = set()

    def fits(a: int, b: int) -> bool:
        to[a] = b
        mapped = sorted((to[o], kind) for o, kind, _ in one[a].values() if o in to)
        good = mapped == [(o, kind) for o, kind in bonds[b] if o in taken or o == b]
        for x in {a, *(o for o, _, _ in one[a].values())} if good else ():
            if left["atoms"][x]["chiral"] and x in to and all(o in to for o, _, _ in one[x].values()):
                good &= _odd(one[x], left["atoms"][x]["chiral"], to) == _odd(two[to[x]], right["atoms"][to[x]]["chiral"], range(n))
        if not good:
            del to[a]
        return good

    tries = [iter(places.get(colours[order[0]], ()))] if n else []
    while len(to) < n or _sides(left, one, to) != _sides(right, two, range(n)):
        if len(to) == n:  # every atom is mapped, but sides differ: take the last one back
            taken.discard(to.pop(order[-1]))
        a = order[len(to)]
        b = next((b for b in tries[-1] if b not in taken and fits(a, b)), None)
        if b is not None:
            taken.add(b)
            if len(to) < n:
                tries.append(iter(places.get(colours[order[len(to)]], ())))
            continue
        tries.pop()
        if not tries:
            return None
        taken.discard(to.pop(order[len(to) - 1]))
    return [to[i] for i in range(n)]


_PAIR = T.StructType([T.StructField("left", MOLECULE), T.StructField("right", MOLECULE), T.StructField("colours", T.ArrayType(T.LongType())), T.StructField("others", T.ArrayType(T.LongType()))])


@F.udf(T.BooleanType(), useArrow=True)
def _searched(pair):
    return None if pair is None else renumbering(pair["left"], pair["right"], pair["colours"], pair["others"]) is not None


def compared(left: Column, right: Column, left_labels: Column, right_labels: Column) -> Column:
    """Is it the same molecule?  ``left_labels`` and ``right_labels`` are columns made by ``labelled``."""
    other = left_labels["stable"] != right_labels["stable"]
    equal = left_labels["form"] == right_labels["form"]
    pair = F.struct(left.alias("left"), right.alias("right"), left_labels["colours"].alias("colours"), right_labels["colours"].alias("others"))
    searched = _searched(F.when(~other & ~equal, pair).cast(_PAIR))
    return F.when(other, False).when(equal, True).otherwise(searched)


def same_molecules(df: DataFrame, left: str, right: str, to: str = "same") -> DataFrame:
    """Add ``to``: are the strings in two columns the same molecule?  Null where one of them is none.

    A narrow map: every row is read, coloured and compared where it is.  A column that has the name ``to`` is replaced.
    """
    held = F.struct(*df.columns).alias("row")
    both = df.select(held, parse_smiles(left, once=True).alias("left"), parse_smiles(right, once=True).alias("right"))
    named = both.select("row", "left", "right", labelled(F.col("left")).alias("left_labels"), labelled(F.col("right")).alias("right_labels"))
    told = named.select("row", compared(*map(F.col, ("left", "right", "left_labels", "right_labels"))).alias("told"))
    return told.select(*[F.col("row")[c].alias(c) for c in df.columns if c.lower() != to.lower()], F.col("told").alias(to))
