"""Registered queries of this folder's operators and the SQL that checks them.

Every query applies its operator with its usual parameters to whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specengine.llm import (
    dart_minhash, language_id, learned_partitions, license_align, mixing, packing, prefix_trie, quality_lm,
    quality_rules, scaled_sketch, toxicity, warc_dict, whitening,
)
from specengine.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op1_mixing": mixing.MIX_SQL, "op12_prefix_trie": prefix_trie.TRIE_SQL}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


@query
def op2_quality_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality_lm.fit(docs, table(spark, folder, "labels"))
    return quality_lm.classify(docs.select("doc_id", "lang", "text"), model, keep_text=False).select(
        "doc_id", "lang", "perplexity", "bits_per_byte", "bits_limit", "kept")


@query
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents").select("doc_id", "lang", "source", "text"))


@query
def op4_dart_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, folder, "documents"))


@query
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "documents"))


@query
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    scored = toxicity.with_score(docs.select("doc_id", "text"), model, keep_text=False)
    return scored.select(
        "doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.LIMIT).cast("int").alias("predicted"), "mean_ratio", "window_ratio")


@query
def op8_warc_dict(spark: SparkSession, folder: str) -> DataFrame:
    return warc_dict.archive(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


@query
def op9_license_align(spark: SparkSession, folder: str) -> DataFrame:
    return license_align.scan(table(spark, folder, "documents"))


@query
def op10_scaled_sketch(spark: SparkSession, folder: str) -> DataFrame:
    return scaled_sketch.fingerprints(table(spark, folder, "documents"))


@query
def op11_learned_partitions(spark: SparkSession, folder: str) -> DataFrame:
    return learned_partitions.search(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)


@query
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, folder, "conversations"))


@query
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))
