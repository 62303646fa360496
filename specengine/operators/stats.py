"""Statistics, histograms and fits as plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specengine.operators.skew import salted_join
from specengine.session import store


def linear_fit(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Slope, both intercepts and correlation; 0 where there is no fit."""
    def safe(c: Column) -> Column:
        return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))

    fit = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        safe(F.regr_slope(y, x)).alias("slope"),
        safe(F.regr_intercept(y, x)).alias("y_intercept"),
        safe(F.corr(x, y)).alias("correlation"))
    return fit.withColumn("x_intercept", F.when(
        F.col("slope") == 0, 0.0).otherwise(-F.col("y_intercept") / F.col("slope")))


def variable_statistics(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """n, sum, sum of squares, mean and population deviation."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("total_squares"),
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"))


def statistics(df: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """n, sum, sum of squares, least, greatest, mean and sample deviation."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("total_squares"),
        F.min(v).alias("least"), F.max(v).alias("greatest"), F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"))


def histogram_fn(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins over [low, high); 0 and bins + 1 hold what lies outside."""
    return df.groupBy(F.width_bucket(
        F.col(value), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def count_by_key(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def show_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return count_by_key(df, keys).orderBy(F.desc("n"), *keys)


def max_by_radius(df: DataFrame, x: str, y: str) -> DataFrame:
    """The row farthest from the origin; equal radii go to the larger (x, y)."""
    radius = F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))
    return df.agg(F.max(F.struct(radius.alias("radius"), F.col(x), F.col(y))).alias("m")).select(
        "m.*")


def group_values(df: DataFrame, key: str, value: str, chunk: int = 10_000) -> DataFrame:
    """All values of each key as lists: key, part, values (ARRAY<STRUCT<value, n>>).

    Equal values are counted first.  A key with more than `chunk` different
    values is spread over several lists by the hash of the value, so no list
    grows with the data and no value is lost.
    """
    counted = df.groupBy(key, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    sizes = counted.groupBy(key).agg(
        F.ceil(F.count(F.lit(1)) / chunk).cast("long").alias("_parts"))
    placed = salted_join(counted, sizes, [key]).withColumn(
        "part", F.pmod(F.xxhash64("value"), F.col("_parts")))
    return placed.groupBy(key, "part").agg(
        F.sort_array(F.collect_list(F.struct("value", "n"))).alias("values"))


def long_if_fits(df: DataFrame, *names: str) -> DataFrame:
    """Decimal columns of few rows as LONG if every value fits, otherwise as they are.

    The rows are stored, as they are read twice.
    """
    kept = store(df, "sums")
    most = kept.agg(*[F.max(F.abs(F.col(n))).alias(n) for n in names]).first()
    if any(most[n] is not None and most[n] >= 1 << 63 for n in names):
        return kept
    return kept.withColumns({n: F.col(n).cast("long") for n in names})
