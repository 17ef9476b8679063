"""Operators that SQL can express, against their SQL on the smallest tables."""

import math
import os

import pytest

from fragmill.llm.oracles import ORACLES
from fragmill.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    path = f"{DATA}/documents.parquet"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    same = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    want = sorted((tuple(same(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(same(r[c]) for c in cols) for r in df.collect()), key=repr) == want
