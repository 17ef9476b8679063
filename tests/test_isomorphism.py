"""Graph comparison: against all renumberings of small random molecules, and on known pairs."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from fragmill.functions.columns import MOLECULE
from fragmill.operators import isomorphism as iso
from fragmill.plans.evaluate import accuracy, round_trips
from fragmill.plans.fixtures import SAME
from fragmill.plans.model import FragmentTokenizer

EMPTY = dict(charge=0, isotope=0, atom_map=0, aromatic=False, written_h=0, implied_h=0, bracket=False, in_ring=False, degree=0, order_sum=0, environments=0)


def made(rng, n):
    atoms = [EMPTY | dict(element=rng.choice([6, 6, 6, 8]), chiral=rng.choice([0, 0, 0, 1, 2])) for _ in range(n)]
    ends = [(i, rng.randrange(i)) for i in range(1, n) if rng.random() < 0.9]
    ends += [e for e in permutations(range(n), 2) if rng.random() < 0.08 and e not in ends and e[::-1] not in ends and e[0] < e[1]]
    bonds = [dict(a=a, b=b, kind=rng.choice([1, 1, 2]), stereo=0, in_ring=False) for a, b in ends]
    for b in bonds:
        b["stereo"] = rng.choice([0, 1, -1]) if b["kind"] == 1 else 0
    return {"atoms": atoms, "bonds": bonds}


def neighbours(m, i):
    return [b["b"] if b["a"] == i else b["a"] for b in m["bonds"] if i in (b["a"], b["b"])]


def odd(order):
    return sum(x > y for i, x in enumerate(order) for y in order[i + 1 :]) % 2


def renumbered(rng, m):
    n = len(m["atoms"])
    to = rng.sample(range(n), n)
    bonds = []
    for b in rng.sample(m["bonds"], len(m["bonds"])):
        turn = rng.random() < 0.5
        a, z = (b["b"], b["a"]) if turn else (b["a"], b["b"])
        bonds.append(b | dict(a=to[a], b=to[z], stereo=-b["stereo"] if turn else b["stereo"]))
    atoms = [None] * n
    for i in range(n):
        atoms[to[i]] = dict(m["atoms"][i])
    out = {"atoms": atoms, "bonds": bonds}
    for i in range(n):
        was, now = [to[x] for x in neighbours(m, i)], neighbours(out, to[i])
        if m["atoms"][i]["chiral"] and odd(was) != odd(now):
            atoms[to[i]]["chiral"] = 3 - m["atoms"][i]["chiral"]
    return out


def changed(rng, m):
    out = {"atoms": [dict(a) for a in m["atoms"]], "bonds": [dict(b) for b in m["bonds"]]}
    what = rng.choice(["chiral", "stereo", "element", "bond"])
    if what == "chiral" and out["atoms"]:
        a = rng.choice(out["atoms"])
        a["chiral"] = 3 - a["chiral"] if a["chiral"] else 0
    elif what == "stereo" and out["bonds"]:
        b = rng.choice(out["bonds"])
        b["stereo"] = -b["stereo"]
    elif what == "element" and out["atoms"]:
        rng.choice(out["atoms"])["element"] = 7
    elif out["bonds"]:
        b = rng.choice(out["bonds"])
        b["kind"] = 3 - b["kind"]
        b["stereo"] = 0
    return out


def sides(m, to):
    """Double bonds marked at both ends -> is the end whose highest neighbour is above the same for both?"""
    out = {}
    for b in m["bonds"]:
        if b["kind"] != 2:
            continue
        above = []
        for end in (b["a"], b["b"]):
            seen = {to[o["b"] if o["a"] == end else o["a"]]: o["stereo"] if o["a"] == end else -o["stereo"] for o in m["bonds"] if o is not b and end in (o["a"], o["b"])}
            top = max(seen, default=None)
            told = [s if x == top else -s for x, s in sorted(seen.items()) if s]
            above.append(told[0] if told else 0)
        if all(above):
            out[frozenset((to[b["a"]], to[b["b"]]))] = above[0] == above[1]
    return out


def brute(one, two):
    n = len(one["atoms"])
    if n != len(two["atoms"]) or len(one["bonds"]) != len(two["bonds"]):
        return False
    plain = lambda a: (a["element"], a["chiral"] > 0)
    tied = {(frozenset((b["a"], b["b"])), b["kind"]) for b in two["bonds"]}
    for to in permutations(range(n)):
        if any(plain(one["atoms"][i]) != plain(two["atoms"][to[i]]) for i in range(n)) or {(frozenset((to[b["a"]], to[b["b"]])), b["kind"]) for b in one["bonds"]} != tied:
            continue
        turn = lambda m, i, key: (m["atoms"][i]["chiral"] + odd([key[x] for x in neighbours(m, i)])) % 2
        if all(turn(one, i, to) == turn(two, to[i], range(n)) for i in range(n) if one["atoms"][i]["chiral"]) and sides(one, to) == sides(two, range(n)):
            return True
    return False


def consistent(m):
    """Marks at one end of a double bond must not contradict each other, as they can't in a real molecule."""
    for i in range(len(m["atoms"])):
        up = [b["stereo"] if b["a"] == i else -b["stereo"] for b in m["bonds"] if i in (b["a"], b["b"]) and b["stereo"]]
        doubles = sum(b["kind"] == 2 for b in m["bonds"] if i in (b["a"], b["b"]))
        if doubles and (doubles > 1 or len(neighbours(m, i)) > 3 or (len(up) == 2 and up[0] == up[1])):
            return False
    return True


def test_against_all_renumberings(spark):
    rng = random.Random(5)
    rows, want = [], []
    while len(rows) < 240:
        one = made(rng, rng.randrange(1, 7))
        two = renumbered(rng, one if rng.random() < 0.4 else changed(rng, one))
        if consistent(one) and consistent(two):
            want.append(brute(one, two))
            rows.append((len(rows), one, two))
    assert 60 < sum(want) < 200
    schema = f"id int, one {MOLECULE.simpleString()}, two {MOLECULE.simpleString()}"
    df = spark.createDataFrame(rows, schema).repartition(4)
    df = df.select("id", "one", "two", iso.labelled(F.col("one")).alias("x"), iso.labelled(F.col("two")).alias("y"))
    got = {r["id"]: r["same"] for r in df.select("id", iso.compared(*map(F.col, ("one", "two", "x", "y"))).alias("same")).collect()}
    assert [got[i] for i in range(len(rows))] == want
    # The search alone, with no colours but what the atoms are.
    alone = [[x["element"] * 2 + (x["chiral"] > 0) for x in m["atoms"]] for row in rows for m in row[1:]]
    assert [iso.renumbering(a, b, x, y) is not None for (_, a, b), x, y in zip(rows, alone[::2], alone[1::2])] == want


def test_pairs(spark):
    df = spark.createDataFrame([*SAME, *[(b, a, s) for a, b, s in SAME], ("C", "C(", None), (None, "C", None), ("", "", True)], "one string, SAME string, want boolean")
    out = iso.same_molecules(df, "one", "SAME", "told").collect()
    assert [(r["one"], r["SAME"]) for r in out if r["told"] != r["want"]] == [] and len(out) == 2 * len(SAME) + 3
    assert iso.same_molecules(df.limit(0), "one", "SAME", "want").collect() == []


def test_large_ring(spark):
    """A ring of 120 equal atoms: its colours never split."""
    ring = "C1" + "C" * 118 + "C1"
    df = spark.createDataFrame([(ring, "C(" + "C" * 118 + "C1)1"), (ring, "C1" + "C" * 58 + "C1.C1" + "C" * 58 + "C1")], "one string, two string")
    assert sorted(r["same"] for r in iso.same_molecules(df, "one", "two").collect()) == [False, True]


def test_accuracy_sees_what_the_encoder_loses(spark):
    # The last one's double bond is cut; its marks come back at both ends of the ring closures, C\\1 and S/1, which agree.
    df = spark.createDataFrame([("CCOCC",), ("CSi",), ("no molecule",), (r"BrC1=CC=C2NC(=O)/C(=C3\SC(=S)NC3=O)C2=C1",)], "smiles string")
    model = FragmentTokenizer([])
    assert accuracy(round_trips(df, model)).first()["n_ok"] == 4
    tested = round_trips(df, model, compare="molecules")
    assert [r["smiles"] for r in tested.collect() if not r["ok"]] == ["CSi"] and accuracy(tested).first()["n_ok"] == 3
    with pytest.raises(ValueError, match="compare"):
        round_trips(df, model, compare="x")
