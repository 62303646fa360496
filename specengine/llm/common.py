"""Helpers shared by the operators of this folder: tables, checked broadcasts, words of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specengine.session import scratch_path

#: A word, in Java and DuckDB patterns: everything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a side of a join may be broadcast (a few dozen MB of ids).
BROADCAST_ROWS = 1_000_000
#: Bytes of text that a Python step holds as numbers at a time; steps with many numbers a byte take fewer.
CHUNK_BYTES, FEW_BYTES = 4_000_000, 1_000_000

U = np.uint64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_or_shuffled(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a join side for broadcast if it is counted and small; else leave the join to shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame into the shared folder and read it back: later steps see the same rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[
        column.offset:column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text",
           most: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a chunk has about `most` bytes of text and at most `rows` rows, and one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at = utf8(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, min(first + rows, int(np.searchsorted(at, at[first] + most, "right")) - 1))
            yield batch.slice(first, last - first)
            first = last


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = U(0x9E3779B97F4A7C15)
    inverse = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    up, down = np.full(n, base, U), np.full(n, inverse, U)
    up[0] = down[0] = U(1)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, at least n of each."""
    return _powers(1 << max(16, int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's last steps)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they lie; spans aren't empty."""
    if len(start) == 0:
        return np.zeros(0, U)
    up, down = powers(len(data))
    sums = np.cumsum((data.astype(U) + U(1)) * up[:len(data)])
    before = np.where(start > 0, sums[start - 1], U(0))
    return mix((sums[end - 1] - before) * down[start] + (end - start).astype(U))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def spans(keep: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the runs in which `keep` holds; `at` has the rows' offsets, which end runs."""
    if len(keep) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(keep) + 1, bool)
    edge[at] = True
    before = np.concatenate(([False], keep[:-1]))
    after = np.concatenate((keep[1:], [False]))
    start = np.flatnonzero(keep & (~before | edge[:-1]))
    end = np.flatnonzero(keep & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words of all rows, in order."""
    return spans(~_SPACE[data], at)


def shingle_hashes(word: np.ndarray, row: np.ndarray, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of `size` words of a row; a row of fewer words is one run of all of them."""
    if len(word) == 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    up, down = powers(len(word))
    sums = np.concatenate(([U(0)], np.cumsum(mix(word) * up[:len(word)])))
    n = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    place = np.arange(len(word)) - first[row]
    length = np.minimum(n[row], size)
    begin = np.flatnonzero(place + length <= n[row])
    stop = begin + length[begin]
    return mix((sums[stop] - sums[begin]) * down[begin] + length[begin].astype(U)), row[begin]


def add_columns(batch: pa.RecordBatch, drop: tuple[str, ...] = (), **columns) -> pa.RecordBatch:
    """The batch without some columns and with others behind it."""
    kept = [(f, batch.column(i)) for i, f in enumerate(batch.schema) if f.name not in drop]
    new = [(pa.field(k, v.type), v) for k, v in ((k, pa.array(v) if not isinstance(v, pa.Array) else v)
                                                 for k, v in columns.items())]
    return pa.RecordBatch.from_arrays([a for _, a in kept + new], schema=pa.schema([f for f, _ in kept + new]))


def fresh(df: DataFrame, *names: str) -> dict[str, str]:
    """Names for working columns that no column of the frame has, whatever its case."""
    have = {c.lower() for c in df.columns}
    out = {}
    for name in names:
        new = name
        while new.lower() in have:
            new = f"_{new}"
        have.add(new.lower())
        out[name] = new
    return out
