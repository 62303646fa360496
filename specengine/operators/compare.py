"""Comparison of two result sets.

A result set has id, charge, rank, peptide, score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Score tolerance of a perfect match, limits of close and of much better.
SCORE_TOLERANCE = 0.03
CLOSE, MUCH_BETTER = 0.20, 0.50
TOP_LIST = 8


def best_rows(results: DataFrame, keys: list[str]) -> DataFrame:
    return results.groupBy(*keys).agg(
        F.max(F.struct("score", "peptide")).alias("b")).select(
        *keys, F.col("b.peptide").alias("peptide"), F.col("b.score").alias("score"))


def compare_results(a: DataFrame, b: DataFrame, keys: list[str] = ("id", "charge"),
                    listed: int = TOP_LIST) -> DataFrame:
    """Class of every best match of `a` against the ranked matches of `b`.

    perfect (same peptide, score within 3%), same_peptide, lower_rank (b has
    it, but not first), other_peptide, no_scan.  b's best comes from an
    aggregate and the lookup in its list is an equi-join on peptide, so
    neither grows with the number of matches per scan.
    """
    keys = list(keys)
    first = best_rows(a, keys)
    second = best_rows(b, keys).select(
        *keys, F.col("peptide").alias("peptide_b"), F.col("score").alias("score_b"))
    inside = b.filter(F.col("rank") <= listed).select(*keys, "peptide").distinct().withColumn(
        "_listed", F.lit(True))
    df = first.join(second, keys, "left").join(inside, [*keys, "peptide"], "left")
    same = F.col("peptide") == F.col("peptide_b")
    error = F.abs(F.col("score") - F.col("score_b")) / F.greatest("score", "score_b")
    return df.withColumn("class", F.when(F.col("peptide_b").isNull(), "no_scan")
                         .when(same & (error <= SCORE_TOLERANCE), "perfect")
                         .when(same, "same_peptide")
                         .when(F.col("_listed"), "lower_rank")
                         .otherwise("other_peptide")).drop("_listed")


def tied_scores(results: DataFrame, keys: list[str] = ("id", "charge")) -> DataFrame:
    """Scans whose best score is reached by more than one peptide, per whole score."""
    keys = list(keys)
    per = results.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("n"))
    top = per.groupBy(*keys).agg(F.max(F.struct("score", "n")).alias("t"))
    return top.filter(F.col("t.n") > 1).groupBy(
        F.col("t.score").cast("int").alias("score_bin")).agg(F.count(F.lit(1)).alias("n_scans"))


def comparison_classes(a: DataFrame, b: DataFrame, keys: list[str] = ("id",)) -> DataFrame:
    """Equal, close, better or much better, or present on one side only."""
    keys = list(keys)
    left = best_rows(a, keys).select(
        *keys, F.col("peptide").alias("peptide_a"), F.col("score").alias("score_a"))
    right = best_rows(b, keys).select(
        *keys, F.col("peptide").alias("peptide_b"), F.col("score").alias("score_b"))
    df = left.join(right, keys, "full")
    delta = F.col("score_a") - F.col("score_b")
    relative = F.abs(delta) / F.greatest("score_a", "score_b")
    return df.withColumn("class", F.when(F.col("score_b").isNull(), "only_a")
                         .when(F.col("score_a").isNull(), "only_b")
                         .when(F.col("peptide_a") == F.col("peptide_b"), "equal")
                         .when(relative < CLOSE, "close")
                         .when((delta > 0) & (relative > MUCH_BETTER), "a_much_better")
                         .when(delta > 0, "a_better")
                         .when(relative > MUCH_BETTER, "b_much_better")
                         .otherwise("b_better"))


def comparison_summary(a: DataFrame, b: DataFrame, keys: list[str] = ("id",)) -> DataFrame:
    return comparison_classes(a, b, keys).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def found_in_top(a: DataFrame, b: DataFrame, keys: list[str] = ("id",),
                 listed: int = TOP_LIST) -> DataFrame:
    """Scans whose best peptide of `a` is in the top list of `b`."""
    keys = list(keys)
    inside = b.filter(F.col("rank") <= listed).select(*keys, "peptide").distinct()
    return best_rows(a, keys).join(inside, [*keys, "peptide"], "left_semi").select(*keys)
