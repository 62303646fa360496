"""Joins and numbering that stay even when one key holds a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from specengine.session import checkpoint, store

ROWS_PER_TASK = 30_000
#: Pairs of a key that one task makes at most.
PAIRS_PER_TASK = 5_000_000
MAX_HOT_KEYS = 100_000


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK,
             name: str = "parts") -> DataFrame:
    """Keys that need splitting, with the number of parts each one needs.

    A key counts as hot above `rows_per_task` rows and above 1/100,000 of all
    rows.  At most 100,000 keys can exceed that share, so the result is small
    whatever the data, and it is safe to broadcast.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar()
    return counts.filter(
        (F.col("_n") > rows_per_task) & (F.col("_n") * F.lit(MAX_HOT_KEYS) > total)
    ).select(*keys, F.ceil(F.col("_n") / rows_per_task).cast("int").alias(name))


def row_hash(df: DataFrame) -> Column:
    plain = [f.name for f in df.schema.fields
             if f.dataType.typeName() in ("string", "long", "integer", "double", "float", "short",
                                          "byte", "boolean", "date", "timestamp",
                                          "timestamp_ntz", "decimal")]
    return F.xxhash64(*plain)


def key_parts(left: DataFrame, right: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK,
              pairs_per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """Keys of both sides that must be cut, with the parts of the left (_a) and the right side (_b).

    A part of a side has at most `rows_per_task` rows, and two parts that meet
    make at most `pairs_per_task` pairs: the side with the larger parts is cut
    further until they do.
    """
    n_left = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_l"))
    n_right = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r"))
    a, b = (F.ceil(F.col(n) / rows_per_task).cast("long") for n in ("_l", "_r"))
    cut = n_left.join(n_right, list(keys)).filter(
        (F.col("_l") > rows_per_task) | (F.col("_r") > rows_per_task)
        | (F.col("_l").cast("double") * F.col("_r") > pairs_per_task)).withColumn("_a", a).withColumn("_b", b)
    rows_left, rows_right = F.ceil(F.col("_l") / F.col("_a")), F.ceil(F.col("_r") / F.col("_b"))
    left_is_larger = rows_left >= rows_right
    allowed = F.greatest(F.lit(1), F.floor(F.lit(pairs_per_task) / F.least(rows_left, rows_right)))
    more = F.ceil(F.greatest(rows_left, rows_right) / allowed).cast("long")
    return cut.withColumn("_m", more).withColumn("_is_left", left_is_larger).select(
        *keys, F.when(F.col("_is_left"), F.col("_a") * F.col("_m")).otherwise(F.col("_a")).cast("int").alias("_a"),
        F.when(F.col("_is_left"), F.col("_b")).otherwise(F.col("_b") * F.col("_m")).cast("int").alias("_b"))


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                rows_per_task: int = ROWS_PER_TASK,
                sized_by: tuple[DataFrame, DataFrame] | None = None,
                pairs_per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """Inner equi-join in which keys with many rows or pairs are cut into blocks on both sides.

    A key with `a` blocks of left rows and `b` blocks of right rows becomes
    a * b independent join keys: each left row goes to one left block and is
    copied to the b right blocks, and the other way round.  Every pair of
    matching rows meets exactly once.  Rows are placed by their hash, so a
    retried task places them in the same block.  The list of cut keys is
    stored and counted: without one the join is a plain one, up to 100,000 keys
    they are broadcast, and joined by a shuffle beyond.  `sized_by` gives narrower frames with (at least) the same keys, on which
    they are counted.
    """
    keys = list(keys)
    cut = store(key_parts(*(sized_by or (left, right)), keys, rows_per_task, pairs_per_task), "cut")
    n = cut.count()
    if not n:
        return left.join(right, keys)
    hot = F.broadcast(cut) if n <= MAX_HOT_KEYS else cut

    def place(df: DataFrame, own: str, other: str) -> DataFrame:
        block = row_hash(df)
        return (
            df.withColumn("_block", block)
            .join(hot, keys, "left")
            .withColumn(f"_s{own}", F.pmod("_block", F.coalesce(F.col(own), F.lit(1)).cast("long")))
            .withColumn(f"_s{other}", F.explode(F.sequence(
                F.lit(0).cast("long"), F.coalesce(F.col(other), F.lit(1)).cast("long") - 1)))
            .drop("_block", "_a", "_b")
        )

    salts = ["_s_a", "_s_b"]
    return place(left, "_a", "_b").join(place(right, "_b", "_a"), keys + salts).drop(*salts)


def with_row_index(df: DataFrame, order: Sequence[str | Column], name: str = "index",
                   start: int = 0, keep: str | None = None) -> DataFrame:
    """Dense index in global order, without moving all rows into one task.

    Rows are range-partitioned and sorted, stored once in the shared folder,
    and numbered by partition offset plus place in the partition.  The offsets
    frame has one row per partition.  `order` should end with a unique column.
    `keep` names a column for the row's range.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*",
        F.spark_partition_id().alias("_p"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_i"),
    )
    placed = checkpoint(placed)
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select(
        "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    numbered = placed.join(F.broadcast(offsets), "_p").withColumn(
        name, F.col("_offset") + F.col("_i") + F.lit(start).cast("long")).drop("_i", "_offset")
    return numbered.withColumnRenamed("_p", keep) if keep else numbered.drop("_p")


def with_group_index(df: DataFrame, group: Sequence[str], order: Sequence[str | Column],
                     name: str = "index") -> DataFrame:
    """0-based index inside each group; a hot group is spread over many tasks.

    One global numbering by (group, order) is made, and the first number of a
    group is taken off again.  That number is attached by (range, group), of
    which none has more rows than a range of the sort, however large the group.
    """
    indexed = with_row_index(df, [*group, *order], "_g", keep="_p")
    here = indexed.groupBy("_p", *group).agg(F.min("_g").alias("_here"))
    first = here.groupBy(*group).agg(F.min("_here").alias("_first"))
    firsts = here.drop("_here").join(first, list(group))
    return indexed.join(firsts, ["_p", *group]).withColumn(
        name, F.col("_g") - F.col("_first")
    ).drop("_g", "_first", "_p")
