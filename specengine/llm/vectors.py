"""Vectors for the operators on embeddings: which rows take part, Arrow lists as matrices, sums over partitions."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial sums that the driver adds itself; more are added by tasks first.
PARTIALS = 64


def usable(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, vector) of the rows whose vector has entries, all finite and none null.

    Only vectors of the most common length take part (of the longer one in a
    tie), as others have no product with them.
    """
    rows = df.select(F.col(id_column).alias("id"), F.col(column).alias("vector")).filter(
        F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall(
            "vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < math.inf)))
    length = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("vector") == F.lit(length.d if length else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def total(rows: DataFrame, part: Callable[[np.ndarray], tuple], column: str = "x") -> tuple | None:
    """The sum of `part(matrix of some rows)`, a tuple of things that can be added; None without rows.

    A task adds up its batches and passes on one sum.  Beyond a few dozen tasks
    other tasks add those, so the driver gets a bounded number of sums.
    """
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            if batch.num_rows:
                new = part(matrix(batch.column(batch.schema.get_field_index(column))))
                out = new if out is None else tuple(a + b for a, b in zip(out, new))
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out)], pa.binary())], ["sums"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for new in map(pickle.loads, batch.column(0).to_pylist()):
                out = new if out is None else tuple(a + b for a, b in zip(out, new))
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out)], pa.binary())], ["sums"])

    parts = rows.rdd.getNumPartitions()
    found = rows.select(column).mapInArrow(sums, "sums binary")
    while parts > PARTIALS:
        parts = math.ceil(parts / PARTIALS)
        found = found.repartition(parts).mapInArrow(again, "sums binary")
    out = None
    for row in found.collect():
        new = pickle.loads(row.sums)
        out = new if out is None else tuple(a + b for a, b in zip(out, new))
    return out
