"""Band joins: equi-join on whole-number bins, then the exact predicate."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specengine.operators.skew import ROWS_PER_TASK, salted_join


def bin_of(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(float(width))).cast("long")


def range_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str,
               below: float | Column, above: float | Column, keys: Sequence[str] = (), width: float | None = None,
               predicate: Callable[[], Column] | None = None,
               rows_per_task: int = ROWS_PER_TASK,
               sized_by: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Pairs with left - below <= right <= left + above, plus equality on `keys`.

    The right row has one bin; the left row goes to each bin its window
    touches, so every pair is met once.  With the default width (the window)
    that is two bins.  Bins with many rows or pairs are cut on both sides.  The
    reach may be a column of the left side; the width is needed then.
    """
    width = width or max(below + above, 1e-9)
    low, high = F.col(left_value) - below, F.col(left_value) + above

    def windows(df: DataFrame) -> DataFrame:
        return df.withColumn(
            "_bin", F.explode(F.sequence(bin_of(low, width), bin_of(high, width))))

    def bins(df: DataFrame) -> DataFrame:
        return df.withColumn("_bin", bin_of(F.col(right_value), width))

    sizes = (windows(sized_by[0]), bins(sized_by[1])) if sized_by else None
    pairs = salted_join(
        windows(left), bins(right), [*keys, "_bin"], rows_per_task, sizes).drop("_bin")
    exact = predicate() if predicate else F.col(right_value).between(low, high)
    return pairs.filter(exact)
