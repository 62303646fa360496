"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

A stage takes (spark, docs, folder of the tables) and works on everything that its predecessor kept.
All but the last return the columns of documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from specengine.llm import dart_minhash, mixing, packing, quality_lm, toxicity
from specengine.llm.common import stored, table
from specengine.session import bound_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """A stage whose Python steps get batches of bounded bytes."""
    @functools.wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, folder)

    return call


@bounded
def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the n-gram model of trusted text finds likely enough in their language."""
    return quality_lm.keep_quality(docs, table(spark, folder, "labels"))


@bounded
def ordinary(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that aren't toxic."""
    return toxicity.keep_ordinary(docs, table(spark, folder, "labels"))


@bounded
def distinct_texts(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return dart_minhash.without_near_duplicates(docs)


@bounded
def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sources at their target weights, with repeats."""
    return mixing.mixed_documents(docs)


@bounded
def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of token ids in context windows."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality), ("toxicity", ordinary), ("near_dedup", distinct_texts), ("mixing", mixed),
    ("packing", packed),
]

#: The models of three stages and the tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, folder), f"pipeline-{name}")
    return docs
