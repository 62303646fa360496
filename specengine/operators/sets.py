"""Set operations between result sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def common_ids(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    return a.select(key).intersect(b.select(key))


def uncommon_ids(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Ids of `a` that `b` does not have."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def union_sources(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_variants(variants: DataFrame) -> DataFrame:
    return variants.select("mod_sequence").distinct()
