"""Row selection: folds, samples, prefixes, middle scans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specengine.operators.skew import with_row_index
from specengine.session import store

BROADCAST_ROWS = 100_000
#: Peptides of one automaton, about.
PEPTIDES_PER_SHARD = 200_000


def sampling_hash(*keys: str, seed: int = 0) -> Column:
    """32 bits of the MD5 of the keys' text: any engine gives the same, however the rows are placed."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def percentile_filter(df: DataFrame, key: str, start: int, end: int) -> DataFrame:
    """Keep the rows whose key falls into hundredths [start, end) of the hash range."""
    return df.filter((sampling_hash(key) % 100).between(start, end - 1))


def nofk_filter(df: DataFrame, order: list[str], n: int, start: int) -> DataFrame:
    """Fold `start` of n: every n-th row in key order.  The n folds are disjoint and complete."""
    return with_row_index(df, order, "_i").filter(
        (F.col("_i") + start) % n == 0).drop("_i")


def first_n(df: DataFrame, order: list[str | Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def random_fraction(df: DataFrame, fraction: float, keys: list[str], seed: int = 17) -> DataFrame:
    """About a fraction of the rows, chosen by their keys and the seed: the same ones in every run."""
    return df.filter(sampling_hash(*keys, seed=seed) < round(fraction * 2**32))


def limit_rows(df: DataFrame, key: str, max_rows: int | None) -> DataFrame:
    """Scale a frame down to about `max_rows`; None keeps everything.

    This is the sampling operator of test runs: the share comes from a count
    and the rows from a hash of the key.
    """
    if max_rows is None:
        return df
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.filter(sampling_hash(key) % 1_000_000 * total < F.lit(max_rows).cast("long") * 1_000_000)


def nonempty_id(df: DataFrame, column: str = "id") -> DataFrame:
    return df.filter(F.length(column) > 0)


def ms2_only(spectra: DataFrame) -> DataFrame:
    return spectra.filter(F.col("ms_level") != 1)


def checked_small(df: DataFrame) -> DataFrame:
    """Broadcast a list only after its size was checked; larger lists join by the planner's choice."""
    few = df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(df) if few else df


def _prefixes(column: str, lengths: list[int]) -> Column:
    return F.explode(F.array_distinct(F.array(
        *[F.substring(column, 1, n) for n in lengths] or [F.lit(None).cast("string")])))


def select_proteins_by_prefix(proteins: DataFrame, ids: DataFrame) -> DataFrame:
    """Proteins whose annotation starts with a listed id, each row as often as it was given.

    Ids of one length are matched by an equi-join on the prefix of that length; there are at most as many
    lengths as the longest id has letters.  Ids that start with another listed id add nothing and are
    dropped, so a row meets one id at most.
    """
    listed = ids.filter(F.col("prefix") != "").select("prefix").distinct()
    lengths = sorted(r[0] for r in listed.select(F.length("prefix")).distinct().collect())
    longer = listed.withColumn("_part", _prefixes("prefix", lengths)).filter("_part <> prefix")
    covered = longer.join(listed.select(F.col("prefix").alias("_part")), "_part").select("prefix")
    least = checked_small(listed.join(covered, "prefix", "left_anti").select(F.col("prefix").alias("_prefix")))
    keyed = proteins.withColumn("_prefix", _prefixes("annotation", lengths))
    return keyed.join(least, "_prefix", "left_semi").drop("_prefix")


def select_proteins_containing(proteins: DataFrame, peptides: DataFrame,
                               shard_rows: int = PEPTIDES_PER_SHARD) -> DataFrame:
    """Proteins whose sequence contains a listed peptide.

    The distinct peptides are counted and dealt into shards of about
    `shard_rows`.  A task builds one automaton of a shard and reads each
    sequence once, to its first hit, so a peptide that every protein holds
    costs no more than any other, and no sequence is shuffled.
    """
    spark = proteins.sparkSession
    listed = store(peptides.filter(F.col("sequence") != "").select("sequence").distinct(), "peptides")
    shards = -(-listed.count() // shard_rows)
    found = spark.createDataFrame([], proteins.select("protein").schema)
    for i in range(shards):
        own = listed.filter(F.pmod(F.xxhash64("sequence"), F.lit(shards)) == i)
        words = spark.sparkContext.broadcast([r.sequence for r in own.collect()])  # one shard
        found = found.union(proteins.select("protein", "sequence").mapInArrow(
            _holders(words), found.schema))
    return proteins.join(found.distinct(), "protein", "left_semi")


def _holders(words: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for word in words.value:
            automaton.add_word(word)
        if not len(automaton):
            return
        automaton.make_automaton()
        for batch in batches:
            hit = [s is not None and next(automaton.iter(s), None) is not None for s in batch.column(1).to_pylist()]
            yield batch.select([0]).filter(pa.array(hit, pa.bool_()))

    return find


def select_middle_scans(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """n rows in order after skipping half of the surplus."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    skip = F.greatest(F.lit(0), F.floor((total - n) / 2))
    return with_row_index(df, order, "_i").filter(
        (F.col("_i") >= skip) & (F.col("_i") < skip + n)).drop("_i")
