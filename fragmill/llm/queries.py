"""The queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.llm import bpe_codec, collocations, exact_dedup, html_wrapper, lm_backoff, mixing, ngram_join, piece_codec, quality_rules, secret_scan, substring_dedup, token_align, token_orc
from fragmill.llm.common import documents
from fragmill.llm.oracles import ORACLES  # noqa: F401


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = bpe_codec.encode(documents(spark, sf_dir).select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    both = bpe_codec.decode(tokens.select("doc_id", "token_ids"), ranks, public_tokenizers.PATTERN)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_wrapper.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir), words=4, percent=85)


def op4_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_backoff.scores(documents(spark, sf_dir))
    return scored.select("doc_id", "n_words", "n_seen_bigrams", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))[0]
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = token_orc.write_and_read(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_orc.crc32(tokens)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, sf_dir))
    base = secret_scan.joined(secret_scan.kinds("assign", "access", "hex"))
    every = secret_scan.joined(secret_scan.kinds("assign", "access", "hex", "entropy"))
    count = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = token_align.align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    counted = token_align.scores(aligned.withColumn("groups_sha256", digest).drop("groups"))
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    tokens = piece_codec.encode(documents(spark, sf_dir).select("doc_id", "text"), path)
    both = piece_codec.decode(tokens.select("doc_id", "piece_ids"), path)
    ids = F.array_join(F.col("piece_ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("piece_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_html_wrapper, op3_ngram_jaccard, op4_stupid_backoff, op5_exact_dedup, op6_quality_rules, op7_mix_sources, op8_token_orc, op9_substring_dedup, op10_secret_scan, op11_collocations, op12_token_alignment, op13_sentencepiece)}
