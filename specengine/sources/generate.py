"""Generated rows for load tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def generate_rows(spark: SparkSession, size: int, partitions: int, seed: int = 17) -> DataFrame:
    """`size` rows over `partitions` tasks: id, a uniform and a normal value."""
    return spark.range(0, size, 1, partitions).select(
        "id", F.rand(seed).alias("uniform"), F.randn(seed + 1).alias("normal"))
