"""Sums over the peptides of each scan's mass window, without making the pairs.

The peptides of a window are one run in order of mass, so their number and the
sum of a whole-number column are differences of running sums.  Scans and
peptides meet in blocks of the mass axis that hold a bounded number of rows; a
block costs its rows, not its pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specengine.operators.blocks import mass_blocks, place
from specengine.operators.kernels import ranges
from specengine.operators.skew import row_hash
from specengine.session import store

#: Rows of one side of a block.
ROWS_PER_BLOCK = 200_000
#: Windows are looked up this much wider; the exact rule decides at both ends.
SLACK = 1e-6

Keeps = Callable[[np.ndarray | float, np.ndarray | int, np.ndarray], np.ndarray]


def run_sums(scan: np.ndarray, charge: np.ndarray, low: np.ndarray, high: np.ndarray, masses: np.ndarray,
             values: np.ndarray, keeps: Keeps) -> tuple[np.ndarray, np.ndarray]:
    """Per scan the number and the sum of the values of the peptides that `keeps` lets pass, a run in order of mass."""
    order = np.argsort(masses, kind="stable")
    distinct, start = np.unique(masses[order], return_index=True)
    start = np.append(start, len(masses))
    sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(values[order])))
    first, last = np.searchsorted(distinct, low), np.searchsorted(distinct, high, "right")
    for edge, step in ((first, 1), (last, -1)):  # what only the slack or rounding put into reach
        moving = np.flatnonzero(first < last)
        while len(moving):
            at = edge[moving] - (step < 0)
            moving = moving[~keeps(scan[moving], charge[moving], distinct[at])]
            edge[moving] += step
            moving = moving[first[moving] < last[moving]]
    last = np.maximum(first, last)
    return start[last] - start[first], sums[start[last]] - sums[start[first]]


class LookedUp(NamedTuple):
    """A scan meets only peptides whose `key` (of masses) lies in first..last, `last` not included."""

    first: Column
    last: Column
    key: Callable[[np.ndarray], np.ndarray]


def looked_up_sums(scan: np.ndarray, charge: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray,
                   masses: np.ndarray, values: np.ndarray, key: np.ndarray, keeps: Keeps) -> tuple[np.ndarray, np.ndarray]:
    """`run_sums` over the peptides of each key that a scan is looked up under: they are a run per key, not over all keys."""
    n, total = np.zeros(len(scan), np.int64), np.zeros(len(scan), np.int64)
    order = np.argsort(key, kind="stable")
    keys, begin = np.unique(key[order], return_index=True)
    begin = np.append(begin, len(order))
    group, of = ranges(np.searchsorted(keys, first), np.searchsorted(keys, last))
    by_group = np.argsort(group, kind="stable")
    group, of = group[by_group], of[by_group]
    edges = np.searchsorted(group, np.arange(len(keys) + 1))
    for g in np.flatnonzero(np.diff(edges)):
        own, rows = of[edges[g]:edges[g + 1]], order[begin[g]:begin[g + 1]]
        more = run_sums(scan[own], charge[own], low[own], high[own], masses[rows], values[rows], keeps)
        n[own] += more[0]
        total[own] += more[1]
    return n, total


def window_sums(scans: DataFrame, library: DataFrame, below: float | Column, above: float | Column, charge: Column,
                keeps: Keeps, value: str, width: float | None = None, rows: int = ROWS_PER_BLOCK,
                looked_up: LookedUp | None = None) -> DataFrame:
    """(id, n, `value`): per scan (id, precursor_mass) the number of its peptides and the sum of their values.

    `keeps` is the exact rule of the window; the peptides that it keeps for a
    scan must be a run in order of mass, or with `looked_up` one per key.  Ids
    without a peptide have no row.
    """
    width = width or below + above
    # Both sides are read twice, to be counted and to be placed.
    mass = F.col("precursor_mass")
    left = store(scans.filter(mass.isNotNull()).select(
        "id", mass.cast("double").alias("precursor_mass"), charge.cast("int").alias("charge"),
        (mass - below - SLACK).cast("double").alias("low"), (mass + above + SLACK).cast("double").alias("high"),
        *([looked_up.first.cast("long").alias("from_key"), looked_up.last.cast("long").alias("to_key")] if looked_up else []),
        F.xxhash64("id").alias("_key")).filter(F.col("charge").isNotNull() & (F.col("low") <= F.col("high"))), "scans")
    right = store(library.filter(F.col("matching_mass").isNotNull()).select(
        F.col("matching_mass").cast("double").alias("matching_mass"),
        F.coalesce(F.col(value), F.lit(0)).cast("long").alias("value"), row_hash(library).alias("_key")), "masses")
    blocks = mass_blocks(left, right, "precursor_mass", "matching_mass", mass - F.col("low"), F.col("high") - mass,
                         float("inf"), width=width, rows=rows)
    left = place(left, blocks, F.col("low"), F.col("high"), True, "_key").drop("_key")
    right = place(right, blocks, F.col("matching_mass"), F.col("matching_mass"), False, "_key").drop("_key")

    key = looked_up.key if looked_up else None  # columns can't be sent to a task

    def summed(mine: pa.Table, others: pa.Table) -> pa.Table:
        given = [mine.column(c).to_numpy() for c in ("precursor_mass", "charge", "low", "high")]
        masses, values = (others.column(c).to_numpy() for c in ("matching_mass", "value"))
        if key:
            n, total = looked_up_sums(*given, *(mine.column(c).to_numpy() for c in ("from_key", "to_key")), masses, values,
                                      key(masses), keeps)
        else:
            n, total = run_sums(*given, masses, values, keeps)
        some = np.flatnonzero(n)
        return pa.table({"id": mine.column("id").take(pa.array(some)), "n": n[some].astype(np.int64),
                         "total": total[some].astype(np.int64)})

    keys = ["block", "a", "b"]
    id_type = scans.schema["id"].dataType.simpleString()
    sums = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(summed, f"id {id_type}, n long, total long")
    return sums.groupBy("id").agg(F.sum("n").alias("n"), F.sum("total").alias(value))
