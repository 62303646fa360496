"""Streaming DataFrames through the stateless operators, and a running word count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from specengine.operators.digest import digest
from specengine.operators.text import word_count


def stream_parquet(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option(
        "maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_word_count(lines: DataFrame, path: str, checkpoint: str,
                       column: str = "text") -> StreamingQuery:
    """Counts of all words so far, kept as state; each trigger writes only the counts that changed.

    A trigger's rows go to a folder of their own, named by its number, which a
    repeated trigger writes anew.
    """
    def write(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/trigger={number}")

    return word_count(lines, column).writeStream.outputMode("update").foreachBatch(write).option(
        "checkpointLocation", checkpoint).start()


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """(word, n) after the last trigger: per word the count of its highest trigger."""
    return spark.read.schema("word string, n long, trigger long").parquet(path).groupBy("word").agg(
        F.max_by("n", "trigger").alias("n"))


def streaming_digest(proteins: DataFrame, path: str, checkpoint: str, rule: str = "trypsin",
                     missed: int = 0) -> StreamingQuery:
    """Peptides of arriving proteins, appended to a Parquet folder."""
    return digest(proteins, rule, missed).writeStream.outputMode("append").format(
        "parquet").option("path", path).option("checkpointLocation", checkpoint).start()
