"""False-discovery rates over target and decoy hits.

A hit is a row with score, is_decoy and, where known, is_modified.  Hits are
counted per score bin first; everything after that works on at most 3200 bins.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specengine.functions.peptide import DECOY
from specengine.functions.spectrum import fdr_bin, linear_bin
from specengine.operators.skew import salted_join


def fdr_counts(hits: DataFrame, keys: list[str] = (),
               bin_of: Callable[[Column], Column] = fdr_bin) -> DataFrame:
    return hits.groupBy(*keys, bin_of(F.col("score")).alias("bin")).agg(
        F.count_if(~F.col("is_decoy")).alias("n_true"),
        F.count_if(F.col("is_decoy")).alias("n_false"))


def fdr_counts_linear(hits: DataFrame, keys: list[str] = ()) -> DataFrame:
    return fdr_counts(hits, keys, linear_bin)


def fdr_at_score(counts: DataFrame, keys: list[str] = (), high_is_better: bool = True) -> DataFrame:
    """Per bin: hits at least as good, and the share of decoys among them."""
    order = F.desc("bin") if high_is_better else F.asc("bin")
    better = W.partitionBy(*keys).orderBy(order) if keys else W.partitionBy(
        F.lit(0)).orderBy(order)
    return counts.select(
        *keys, "bin",
        F.sum("n_true").over(better).alias("n_true"),
        F.sum("n_false").over(better).alias("n_false"),
    ).withColumn("fdr", F.when(F.col("n_true") + F.col("n_false") == 0, 0.0).otherwise(
        F.col("n_false") / (F.col("n_true") + F.col("n_false"))))


def fdr_table(hits: DataFrame, first: float, last: float, factor: float = 1.05) -> DataFrame:
    """FDR, counts, TPR and FPR on a geometric grid of scores.

    The grid and the bins are both small (a fixed axis), whatever the number of hits.
    """
    import math

    steps = int(math.floor(math.log(last / first) / math.log(factor) + 1e-9))
    grid = hits.sparkSession.range(0, steps + 1, 1, 1).select(
        F.col("id").cast("int").alias("step"),
        (F.lit(first) * F.pow(F.lit(factor), F.col("id"))).alias("score"),
    ).withColumn("g", fdr_bin(F.col("score")))
    counts = fdr_counts(hits)
    joined = grid.join(F.broadcast(counts), F.col("bin") >= F.col("g"), "left")
    table = joined.groupBy("step", "score").agg(
        F.coalesce(F.sum("n_true"), F.lit(0)).alias("n_true"),
        F.coalesce(F.sum("n_false"), F.lit(0)).alias("n_false"))
    start = W.partitionBy(F.lit(0)).orderBy("step").rowsBetween(
        W.unboundedPreceding, W.unboundedFollowing)
    rate = lambda c: F.col(c) / F.first(c).over(start)
    total = F.col("n_true") + F.col("n_false")
    return table.withColumn("fdr", F.when(total == 0, 0.0).otherwise(
        F.col("n_false") / total)).withColumn("tpr", rate("n_true")).withColumn(
        "fpr", rate("n_false"))


def fdr_hits(hits: DataFrame, max_rank: int = 1) -> DataFrame:
    """Hits up to a rank whose proteins are all targets or all decoys."""
    decoy = lambda p: p.startswith(DECOY)
    mixed = F.exists("proteins", decoy) & F.exists("proteins", lambda p: ~decoy(p))
    return hits.filter((F.col("rank") <= max_rank) & ~mixed).withColumn(
        "is_decoy", F.exists("proteins", decoy))


def score_range_filter(column: Column, low: float | None = None,
                       high: float | None = None) -> Column:
    tests = []
    if low is not None:
        tests.append(column >= low)
    if high is not None:
        tests.append(column <= high)
    return and_filter(tests)


def and_filter(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates) if predicates else F.lit(True)


def or_filter(predicates: list[Column]) -> Column:
    """Any of the predicates; like `and_filter`, an empty list keeps every row."""
    return reduce(lambda a, b: a | b, predicates) if predicates else F.lit(True)


def filtered_fdr(hits: DataFrame, min_score: float, keys: list[str] = ()) -> DataFrame:
    return fdr_at_score(fdr_counts(hits.filter(
        score_range_filter(F.col("score"), min_score)), keys), keys)


def report_min_hyperscore(groups: DataFrame, limit: float) -> DataFrame:
    return groups.filter(F.col("hyperscore") >= limit)


def protein_hits(hits: DataFrame, unique_only: bool = False) -> DataFrame:
    """Distinct (protein, scan, peptide) of the first-ranked hits.

    With `unique_only`, peptides of a single protein.  Rows, not sets: a
    protein may have any number of hits.
    """
    rows = hits.filter(F.col("rank") == 1).select("protein", "scan", "peptide").distinct()
    if not unique_only:
        return rows
    shared = rows.select("peptide", "protein").distinct().groupBy("peptide").agg(
        F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == 1).select("peptide")
    return salted_join(rows, shared, ["peptide"]).select("protein", "scan", "peptide")


def roc_points(scores: DataFrame, step: float = 0.001, last: float = 0.05,
               value: str = "q") -> DataFrame:
    """How many q-scores lie below each step of 0.001 up to 0.05; empty in, empty out."""
    steps = round(last / step)
    place = F.floor(F.col(value) / step).cast("int") + 1
    counts = scores.filter(F.col(value) < last).groupBy(place.alias("step")).agg(
        F.count(F.lit(1)).alias("_n"))
    grid = scores.sparkSession.range(1, steps + 1, 1, 1).select(F.col("id").cast("int").alias("step"))
    upto = W.partitionBy(F.lit(0)).orderBy("step")
    out = grid.join(F.broadcast(counts), "step", "left").select(
        "step", (F.col("step") * step).alias("q"),
        F.sum(F.coalesce("_n", F.lit(0))).over(upto).alias("n_below"),
        F.sum(F.coalesce("_n", F.lit(0))).over(W.partitionBy(F.lit(0))).alias("_all"))
    return out.filter(F.col("_all") > 0).drop("_all")
