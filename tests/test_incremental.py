"""Training on Spark against training on the driver: the same merges, and rounds that read what they touch."""

import random

import pytest
from pyspark.sql import functions as F

from fragmill.plans.incremental import learn_incremental, next_merges
from fragmill.plans.trainer import learn


def table(spark, rows):
    return spark.createDataFrame(rows, "fragment string, n long").repartition(3)


@pytest.mark.parametrize("seed", range(2))
def test_same_merges(spark, seed):
    rng = random.Random(seed)
    rows = [("".join(rng.choice("CNO(=)c1é") for _ in range(rng.randrange(0, 12))), rng.randrange(1, 4)) for _ in range(60)]
    log = []
    got = learn_incremental(table(spark, rows), 14, every=3, log=log)
    assert got == learn(rows, 14)
    assert sum(x["merges"] for x in log) == 14


def test_short_line_and_ties(spark):
    """All pairs are equally frequent: a line of four never shows where the ties end."""
    rows = [("abcdefgh", 1), ("aaaa", 1), ("xyxyx", 1), ("", 5), ("q", 9)]
    assert learn_incremental(table(spark, rows), 12, line=4) == learn(rows, 12)
    assert learn_incremental(table(spark, [(None, 1), ("", 2)]), 5) == []


def test_rounds_read_what_they_touch(spark):
    rng = random.Random(3)
    rows = [(f"{a}{b}", 2 if a == "Z" else 50) for a in ("ab", "cd", "Z") for b in ("k1", "m2", "p3")] + [("".join(rng.choice("stuvwxyzSTUVWXYZ") for _ in range(4)), 1) for _ in range(300)]
    log = []
    learn_incremental(table(spark, rows), 4, log=log)
    total = sum(max(0, len(set(zip(w, w[1:])))) for w, _ in rows)
    assert all(x["rows_read"] < total / 10 for x in log[:1]) and all(x["rows_read"] >= x["words"] for x in log)
    assert max(x["words"] for x in log[:1]) <= 9


def test_next_merges():
    brute = lambda words, k: learn(words, k)
    rng = random.Random(7)
    several = 0
    for _ in range(300):
        words = [("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))), rng.randrange(1, 30)) for _ in range(12)]
        count = {}
        for w, n in words:
            for a, b in zip(w.encode(), w.encode()[1:]):
                count[a, b] = count.get((a, b), 0) + n
        line = sorted(((a, b, n) for (a, b), n in count.items()), key=lambda x: (-x[2], x[0], x[1]))
        for cut in (len(line), 5):
            now = next_merges(line[:cut], 10, cut >= len(line))
            assert now and now == brute(words, len(now))
            several += len(now) > 1
    assert several > 100
