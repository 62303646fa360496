"""Helpers for array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times inside `body`.

    Spark evaluates what a lambda captures anew for every element; a value
    bound as a lambda variable is evaluated once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is computed exactly once per row.

    A filter on an ordinary computed column is pushed below the projection and
    the column is computed again, with everything it depends on.  A generated
    column is not inlined into what stands above it.
    """
    return df.withColumn(name, F.explode_outer(F.array(value)))
