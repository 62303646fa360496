"""Blocks of the mass axis: spectra and peptides that can be pairs, placed together in even pieces.

Both sides are counted per whole bin of mass first.  Neighbouring bins are then
joined into blocks, and a bin that holds too much is cut into parts on both
sides, so that no block has more than a bounded number of pairs or rows,
whatever the masses look like.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specengine.session import shuffle_partitions

#: Most pairs and rows of one side in a block, and the least pairs for which a block of its own pays.
PAIRS_PER_BLOCK = 5_000_000
ROWS_PER_BLOCK = 40_000
LEAST_PAIRS = 100_000
#: Bins of the mass axis; what lies beyond is counted in the last one.
MAX_BINS = 40_000


class Blocks(NamedTuple):
    """Per bin its block, and per block the parts of the left and the right side."""

    width: float
    block: np.ndarray
    left_parts: np.ndarray
    right_parts: np.ndarray


def _parts(left: float, right: float, target: float, rows: int) -> tuple[int, int]:
    """Parts of both sides of a bin, so that two that meet have at most `rows` a side and about `target` pairs.

    Rows of a side are copied to all parts of the other: both are cut in the ratio that copies fewest rows.
    """
    least_a, least_b = max(1, math.ceil(left / rows)), max(1, math.ceil(right / rows))
    needed = max(1, math.ceil(left * right / target))
    a = max(least_a, min(needed, round(math.sqrt(needed * left / right)) if right else 1))
    b = max(least_b, math.ceil(needed / a))
    return max(least_a, math.ceil(needed / b)), b


def plan_blocks(n_left: np.ndarray, n_right: np.ndarray, width: float, target: float = PAIRS_PER_BLOCK,
                rows: int = ROWS_PER_BLOCK) -> Blocks:
    """Cut the axis by the numbers of rows per bin: `n_left` that touch it and `n_right` that lie in it."""
    pairs = n_left.astype(float) * n_right
    block, left_parts, right_parts = np.zeros(len(pairs), np.int64), [], []
    held = np.zeros(3)
    now = -1
    for i in range(len(pairs)):
        own = np.array([pairs[i], n_left[i], n_right[i]])
        alone = (own > [target, rows, rows]).any()
        if now < 0 or alone or (held + own > [target, rows, rows]).any():
            now += 1
            a = b = 1
            if alone:
                a, b = _parts(n_left[i], n_right[i], target, rows)
            left_parts.append(a)
            right_parts.append(b)
            held = np.full(3, np.inf) if alone else np.zeros(3)  # nothing joins a cut bin
        held = held + own
        block[i] = now
    return Blocks(width, block, np.array(left_parts or [1]), np.array(right_parts or [1]))


def _bin(value: Column, width: float) -> Column:
    return F.least(F.greatest(F.floor(value / F.lit(width)), F.lit(0)), F.lit(MAX_BINS - 1)).cast("int")


def mass_blocks(left: DataFrame, right: DataFrame, mass: str, other: str, below: float | Column, above: float | Column,
                target: float | None = None, most: float = PAIRS_PER_BLOCK, width: float | None = None,
                rows: int = ROWS_PER_BLOCK) -> Blocks:
    """Blocks for pairs with mass - below <= other <= mass + above, from one count of each side.

    Without a `target` the pairs of a block follow the number of partitions, `most` at most.
    The reach may be a column of the left side; the width of a bin is needed then.
    """
    width = width or max(below + above, 1e-6)

    def counted(df: DataFrame, bins: Column) -> np.ndarray:
        out = np.zeros(MAX_BINS, np.int64)
        for r in df.select(F.explode(bins).alias("b")).groupBy("b").count().collect():  # MAX_BINS rows at most
            out[r.b] = r["count"]
        return out

    touched = F.sequence(_bin(F.col(mass) - below, width), _bin(F.col(mass) + above, width))
    n_left = counted(left.filter(F.col(mass).isNotNull()), touched)
    n_right = counted(right.filter(F.col(other).isNotNull()), F.array(_bin(F.col(other), width)))
    if target is None:
        total = float((n_left.astype(float) * n_right).sum())
        target = min(most, max(LEAST_PAIRS, total / (8 * shuffle_partitions(left))))
    return plan_blocks(n_left, n_right, width, target, rows)


def place(df: DataFrame, blocks: Blocks, low: Column, high: Column, is_left: bool, key: str) -> DataFrame:
    """Add block, a, b: a left row goes to each block from `low` to `high`, and to all parts of the other side."""
    spark = df.sparkSession
    # One row per bin and per block, MAX_BINS at most.
    bins = [(i, int(b)) for i, b in enumerate(blocks.block)]
    parts = [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(blocks.left_parts, blocks.right_parts))]
    first, last = (F.broadcast(spark.createDataFrame(bins, f"_{e} int, {e} int")) for e in ("first", "last"))
    spread = df.withColumn("_first", _bin(low, blocks.width)).withColumn("_last", _bin(high, blocks.width)).join(
        first, "_first").join(last, "_last").withColumn(
        "block", F.explode(F.sequence("first", "last"))).drop("_first", "_last", "first", "last")
    own, other = ("_a", "_b") if is_left else ("_b", "_a")
    name, copied = ("a", "b") if is_left else ("b", "a")
    return spread.join(F.broadcast(spark.createDataFrame(parts, "block int, _a int, _b int")), "block").withColumn(
        name, F.pmod(F.xxhash64(key), F.col(own).cast("long")).cast("int")).withColumn(
        copied, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_a", "_b")
