"""Generic map-reduce over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Batches = Iterator[pd.DataFrame]
OUTPUT_ROWS = 10_000


def map_rows(df: DataFrame, mapper: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """A row in, any number of rows out; the mapper sees Arrow batches."""
    return df.mapInPandas(mapper, schema)


def map_reduce(df: DataFrame, mapper: Callable[[Batches], Batches], mapped_schema: str,
               keys: list[str], reducer: Callable[[tuple, Batches], Batches], schema: str,
               combiner: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
               salts: int = 16) -> DataFrame:
    """map, group by key, reduce; the result is a DataFrame, so jobs chain with `transform`.

    Rows are placed and sorted by key, and the reducer gets its group as an
    iterator of batches, never as a whole.  With a `combiner` (mapped rows in,
    fewer mapped rows with the same columns out) batches are combined in the
    mapping task and once more per (key, salt), so that a hot key reaches its
    last reducer as a few combined rows.
    """
    mapped = df.mapInPandas(mapper, mapped_schema)
    if combiner is not None:
        def combine(batches: Batches) -> Batches:
            for batch in batches:
                yield combiner(batch)

        first = mapped.mapInPandas(combine, mapped_schema)
        salt = F.pmod(F.xxhash64(*mapped.columns), F.lit(salts))
        mapped = first.repartition(*keys, salt).mapInPandas(combine, mapped_schema)

    def reduce(batches: Batches) -> Batches:
        held, rows = [], 0
        for key, group in groupby(_key_runs(batches, keys), key=lambda run: run[0]):
            for out in reducer(key, (rows_ for _, rows_ in group)):
                held.append(out)
                rows += len(out)
                if rows >= OUTPUT_ROWS:
                    yield pd.concat(held)
                    held, rows = [], 0
        if held:
            yield pd.concat(held)

    return mapped.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(reduce, schema)


def _key_runs(batches: Batches, keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Consecutive rows of one key, batch by batch."""
    for batch in batches:
        if batch.empty:
            continue
        new = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy().nonzero()[0]
        for start, end in zip(new, [*new[1:], len(batch)]):
            run = batch.iloc[start:end]
            yield tuple(run[keys].iloc[0]), run


def single_output(df: DataFrame, **columns) -> DataFrame:
    """One row in, one row out, as expressions."""
    return df.withColumns(columns)


def chain(df: DataFrame, *jobs: Callable[[DataFrame], DataFrame]) -> DataFrame:
    for job in jobs:
        df = df.transform(job)
    return df


def run_sql(df: DataFrame, query: str, name: str = "input") -> DataFrame:
    """SQL over a frame registered under a name of the query's choice."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.sql(query)


def observed(df: DataFrame, name: str, *metrics) -> DataFrame:
    """Row counters and sums that come with the job that runs anyway."""
    return df.observe(name, *metrics)
