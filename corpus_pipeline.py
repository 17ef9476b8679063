"""A corpus from raw documents to token ids: each stage is an operator of fragmill.llm."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.llm import bpe_codec, exact_dedup, mixing, ngram_join, quality_rules
from fragmill.llm.common import documents, drop_paths, folders_of, shared_table, tables_made

#: Shared tables that the last stage has made.
_made: list[str] = []


def stage(apply):
    """A stage first deletes what the stage before has made, but for what ``docs`` still reads.

    By then the result of the stage before has been written, unless ``docs`` is that very result.
    """

    @functools.wraps(apply)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = folders_of(docs)
        drop_paths(spark, [p for p in _made if p.rsplit("/", 1)[-1] not in read])
        _made[:] = [p for p in _made if p.rsplit("/", 1)[-1] in read]
        with tables_made() as made:
            out = apply(spark, docs)
        _made.extend(made)
        return out

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents that the adaptive rules keep, with all their columns.

    Null and empty texts have no words and go; rows that repeat are judged alike and all stay or
    go; ties at a fence stay; null language or source is a group of its own; columns that clash
    with those of the operator pass through; an empty table stays empty.
    """
    return quality_rules.keep_good(docs)


@stage
def exact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each group of equal texts: the longest as written, of these that with the smallest id.

    Null and empty texts are equal, and one stays; a row that repeats id and text stays once; null
    ids count as the largest; all columns pass through; an empty table stays empty.
    """
    return exact_dedup.keep_one(docs)


@stage
def near(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each group linked by 5-word shingles at a Jaccard similarity of 0.8 or more.

    That with the smallest id stays, null ids counting as the largest; null, empty and word-less texts are
    in no group and stay; a similarity of just 0.8 links; all columns pass through; an empty table stays empty.
    """
    return ngram_join.keep_one(docs, words=5, percent=80)


@stage
def mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Sources at their target weights: a row for each document and epoch, with the words taken.

    Null, empty and word-less texts have nothing to take and go; null source is a source of its own; rows
    that repeat are documents of their own; all columns pass through; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


@stage
def tokens(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Token ids of each row, decoded again: doc_id, lang, source, n_tokens, token_ids, same_bytes.

    Null and empty texts have no ids; rows that repeat are all kept; other columns go; an empty table stays empty.
    """
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe_codec.encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN)
    both = bpe_codec.decode(encoded, ranks, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return both.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", same.alias("same_bytes"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mix), ("byte-level BPE", tokens)]

#: Quantile sketches, similarity groups and byte-pair merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, apply in STAGES[:-1]:
        docs = shared_table(apply(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
