"""Every query against its SQL, at the smallest scale; streams; the driver contract."""

import math
import os

import pytest

import __spark_entry__ as driver
from fragmill.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(DATA):
        path = f"{DATA}/{name}"
        path += "/*.parquet" if os.path.isdir(path) else ""
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


def same(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(same(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(same(r[i]) for i in at) for r in cur.fetchall()), key=repr)


def test_contract(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_windowed_stream(spark, tmp_path):
    from fragmill.streaming.encode import windowed_counts

    rows = [("2024-01-01 00:00:10", "CCCOCC"), ("2024-01-01 00:00:20", "CCO"), ("2024-01-01 00:06:00", "CCO"), ("2024-01-01 01:00:00", "CCO")]
    df = spark.createDataFrame(rows, "at string, smiles string").selectExpr("CAST(at AS TIMESTAMP) AS at", "smiles")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = windowed_counts(stream, "at", "5 minutes", "1 minute")
    run = out.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {(str(r["start"]), r["fragment"]): r["n"] for r in spark.table("windows").collect()}
    assert got[("2024-01-01 00:00:00", "CCO")] == 1 and got[("2024-01-01 00:00:00", "O12")] == 1
