"""The stages on a small corpus, and the registered queries on the smallest tables."""

import os

import pytest

import corpus_pipeline
from fragmill.llm import ngram_join, quality_rules
from fragmill.llm.queries import QUERIES
from test_operators import brute_groups, corpus

DATA = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, tmp_path):
    rows = [(i, t, lang or "en", source or "a", len(t or "")) for i, t, lang, source, _ in corpus(11, 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = after.collect()
        if name != "byte-level BPE":
            assert after.columns == docs.columns
        docs = after
    text = {r[0]: r[1] for r in rows}
    good = {r["doc_id"] for r in quality_rules.judge(spark.createDataFrame(rows, docs_schema())).where("kept").collect()}
    assert {r["doc_id"] for r in seen["quality rules"]} == good
    exact = {}
    for i in good:
        key = "".join((text[i] or "").split())
        exact[key] = min(exact.get(key, (1, 0)), (-len(text[i]), i))
    assert {r["doc_id"] for r in seen["exact dedup"]} == {i for _, i in exact.values()}
    groups, _ = brute_groups([(r["doc_id"], r["text"]) for r in seen["exact dedup"]], 5, 80)
    assert {r["doc_id"] for r in seen["n-gram Jaccard join"]} == set(groups.values())
    assert {r["doc_id"] for r in seen["mixing"]} <= set(groups.values())
    assert all(r["same_bytes"] for r in seen["byte-level BPE"]) and len(seen["byte-level BPE"]) == len(seen["mixing"])


def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_empty_tables(spark):
    docs = spark.createDataFrame([], docs_schema())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_query(spark, name):
    table = "pages" if name.startswith("op2_") else "documents"
    rows = spark.read.parquet(f"{DATA}/{table}.parquet").count()
    assert QUERIES[name](spark, DATA).count() == rows


def test_keep_one_keeps_the_smallest_id(spark):
    df = spark.createDataFrame([(2, "a b c d e f g"), (1, "a b c d e f g"), (3, None), (4, "")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in ngram_join.keep_one(df).collect()) == [1, 3, 4]
