"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, divergence, exact, interactions, lines, mixing, near, packing, rules, sql, substrings, toxicity, urls, warc


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.round_trip(pages.select("page_id", "url", "html")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (toxicity.fold_of() == 1).alias("held_out"), "score", "predicted", "hits")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rules.quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact.dedup_exact(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mixing.mix_sources(docs.select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substrings.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near.dedup_near(docs).select("doc_id", "class_id", "class_size", "kept")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packing.pack(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return interactions.audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: The rules of :func:`op13_url_filters`, of which the longest that fits decides.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = urls.build_index(spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), index)


_ALL = (
    op1_warc, op2_chat_collapse, op3_toxicity, op4_quality_rules, op5_exact_dedup, op6_mix_sources, op7_substring_dedup, op8_line_dedup, op9_near_dedup, op10_packing, op11_source_divergence, op12_filter_interactions,
    op13_url_filters,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "op1_warc": sql.WARC,
    "op2_chat_collapse": sql.CHAT,
    "op4_quality_rules": sql.QUALITY,
    "op5_exact_dedup": sql.EXACT,
    "op6_mix_sources": sql.MIX,
    "op7_substring_dedup": sql.SUBSTRINGS,
    "op8_line_dedup": sql.LINES,
    "op11_source_divergence": sql.DIVERGENCE,
    "op12_filter_interactions": sql.INTERACTIONS,
    "op13_url_filters": sql.url_filters(URL_RULES),
}
