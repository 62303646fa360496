"""From scored pairs to one result per spectrum: best matches, histograms, expectation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Matches carried per spectrum, hyperscore limit of the pair scorer,
# histogram factor, expectation fit limits and defaults.
CARRIED_MATCHES = 8
MIN_HYPERSCORE = 50.0
BIN_FACTOR = 0.05
FIT_MIN_COUNT, FIT_MIN_SURVIVORS = 200, 10
DEFAULT_SLOPE, DEFAULT_INTERCEPT = -0.18, 3.5


# A spectrum's state: its best matches, best first, and the number of scores per bin in unordered pieces.
STATES = ("algorithm string, id {id}, top array<struct<hyperscore:double,peptide:string,charge:int,raw_score:double,score:double>>, "
          "counts array<struct<bin:int,n:bigint>>")


def _keys(psm: DataFrame) -> list[str]:
    return [k for k in ("algorithm", "id") if k in psm.columns]


def top_matches(psm: DataFrame, n: int = CARRIED_MATCHES) -> DataFrame:
    """The n best matches per spectrum with their rank; ties go to the smaller peptide string.

    Every task first keeps its own n best per spectrum, so the shuffle and the
    final window see at most n rows per spectrum and task.  States that carry
    at least n matches may be given instead of pairs.
    """
    if "top" in psm.columns:
        return matches_of(psm).filter(F.col("rank") <= n)
    order = W.partitionBy(*_keys(psm)).orderBy(F.desc("hyperscore"), "peptide")
    return psm.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def best_match(psm: DataFrame) -> DataFrame:
    return top_matches(psm, 1).drop("rank")


def best_and_next(psm: DataFrame) -> DataFrame:
    """One row per spectrum: best peptide and hyperscore, next ones (NULL when alone)."""
    pick = lambda rank, c: F.max(F.when(F.col("rank") == rank, F.col(c)))
    return top_matches(psm, 2).groupBy(*_keys(psm)).agg(
        pick(1, "peptide").alias("best_peptide"),
        pick(1, "hyperscore").alias("best_hyperscore"),
        pick(2, "peptide").alias("next_peptide"),
        pick(2, "hyperscore").alias("next_hyperscore"),
    )


def min_hyperscore(psm: DataFrame, limit: float = MIN_HYPERSCORE) -> DataFrame:
    return psm.filter(F.col("hyperscore") > limit)


def drop_no_match(results: DataFrame) -> DataFrame:
    return results.filter(F.col("best_peptide").isNotNull())


def score_bin(score: Column) -> Column:
    return (score * BIN_FACTOR + 0.5).cast("int")


def hyperscore_histogram(psm: DataFrame) -> DataFrame:
    """(id, bin, n): all scored pairs of a spectrum, counted before the shuffle.  Takes scored pairs or states."""
    if "counts" in psm.columns:
        return histogram_of(psm)
    return psm.groupBy(*_keys(psm), score_bin(F.col("hyperscore")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def combine_scored_scans(parts: list[DataFrame]) -> DataFrame:
    """Add up partial histograms of the same spectra."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    keys = [c for c in out.columns if c != "n"]
    return out.groupBy(*keys).agg(F.sum("n").alias("n"))


def partial_states(rows: pa.Table, carried: int) -> pa.Table:
    """States of the spectra of some scored pairs (algorithm, id, charge, peptide, scores)."""
    if not rows.num_rows:
        return states_of(rows.select(["algorithm", "id"]), np.zeros(0, int), np.zeros(0), np.zeros(0, int), carried,
                         lambda kept: rows)
    codes = [rows.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
             for k in ("algorithm", "id")]
    order = np.lexsort(codes[::-1])
    rows, (first, second) = rows.take(pa.array(order)), (c[order] for c in codes)
    new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
    peptides = rows.column("peptide").combine_chunks().dictionary_encode()
    rank = ranks(peptides.dictionary)[peptides.indices.to_numpy(zero_copy_only=False)]
    return states_of(rows.select(["algorithm", "id"]).take(pa.array(np.flatnonzero(new))), np.cumsum(new) - 1,
                     rows.column("hyperscore").to_numpy(), rank, carried, lambda kept: rows.take(pa.array(kept)))


def ranks(names: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Place of each name in the order of the names."""
    out = np.empty(len(names), np.int64)
    out[pa.compute.sort_indices(names).to_numpy()] = np.arange(len(names))
    return out


def _best(hyperscore: np.ndarray, rank: np.ndarray, spectrum: np.ndarray, begin: np.ndarray, carried: int) -> np.ndarray:
    """The rows of the best matches, by spectrum and best first: one per spectrum is picked at a time."""
    left, picked = hyperscore.copy(), []
    for _ in range(carried):
        best = np.maximum.reduceat(left, begin)
        equal = np.flatnonzero((left == best[spectrum]) & (left > -np.inf))
        if not len(equal):
            break
        equal = equal[np.lexsort((rank[equal], spectrum[equal]))]
        picked.append(equal[np.append(True, spectrum[equal][1:] != spectrum[equal][:-1])])
        left[picked[-1]] = -np.inf
    turn = np.repeat(np.arange(len(picked)), [len(p) for p in picked])
    kept = np.concatenate(picked)
    return kept[np.lexsort((turn, spectrum[kept]))]


def states_of(keys: pa.Table, spectrum: np.ndarray, hyperscore: np.ndarray, rank: np.ndarray, carried: int,
              matches: Callable[[np.ndarray], pa.Table]) -> pa.Table:
    """States of scored pairs whose spectra, the rows of `keys`, are numbered from 0 and come one after another.

    `rank` orders the peptides; `matches` gives the fields of the chosen rows.
    """
    if not len(spectrum):
        return pa.table({"algorithm": pa.array([], pa.string()), "id": keys.column("id").slice(0, 0),
                         "top": pa.array([], _TOP), "counts": pa.array([], _COUNTS)})
    kept = _best(hyperscore, rank, spectrum, np.searchsorted(spectrum, np.arange(keys.num_rows)), carried)
    best = matches(kept)
    top = pa.StructArray.from_arrays(
        [best.column(f.name).combine_chunks().cast(f.type) for f in _TOP.value_type], fields=list(_TOP.value_type))
    most = 2**31 - 1
    bins = np.minimum(np.trunc(hyperscore * BIN_FACTOR + 0.5), most).astype(np.int64)
    cell, n = np.unique(spectrum * (most + 1) + bins, return_counts=True)
    counts = pa.StructArray.from_arrays([pa.array(cell % (most + 1), pa.int32()), pa.array(n, pa.int64())],
                                        fields=list(_COUNTS.value_type))
    ends = lambda of: pa.array(np.searchsorted(of, np.arange(keys.num_rows + 1)), pa.int32())
    return pa.table({
        "algorithm": keys.column("algorithm"), "id": keys.column("id"),
        "top": pa.ListArray.from_arrays(ends(spectrum[kept]), top, type=_TOP),
        "counts": pa.ListArray.from_arrays(ends(cell // (most + 1)), counts, type=_COUNTS)})


_TOP = pa.list_(pa.struct([("hyperscore", pa.float64()), ("peptide", pa.string()), ("charge", pa.int32()),
                           ("raw_score", pa.float64()), ("score", pa.float64())]))
_COUNTS = pa.list_(pa.struct([("bin", pa.int32()), ("n", pa.int64())]))


def merged_states(partial: DataFrame, carried: int = CARRIED_MATCHES) -> DataFrame:
    """One row per spectrum: the only aggregation between scored pairs and their results."""
    ranked = F.array_sort(
        F.flatten(F.collect_list("top")),
        lambda x, y: F.when(x.hyperscore > y.hyperscore, -1).when(x.hyperscore < y.hyperscore, 1)
        .when(x.peptide < y.peptide, -1).when(x.peptide > y.peptide, 1).otherwise(0))
    return partial.groupBy("algorithm", "id").agg(
        F.slice(ranked, 1, carried).alias("top"), F.flatten(F.collect_list("counts")).alias("counts"))


def spectrum_states(psm: DataFrame, carried: int = CARRIED_MATCHES) -> DataFrame:
    """States of scored pairs; tasks combine their batches before the one shuffle by spectrum."""
    none = lambda name, kind: psm[name] if name in psm.columns else F.lit(None).cast(kind).alias(name)
    rows = psm.select(
        none("algorithm", "string"), "id", none("charge", "int").cast("int").alias("charge"), "peptide",
        none("raw_score", "double"), none("score", "double"), F.col("hyperscore").cast("double").alias("hyperscore"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from partial_states(pa.Table.from_batches([batch]), carried).to_batches()

    return merged_states(rows.mapInArrow(part, STATES.format(id=psm.schema["id"].dataType.simpleString())), carried)


def matches_of(states: DataFrame) -> DataFrame:
    """The best matches of the states as rows with their rank."""
    return states.select("algorithm", "id", F.posexplode("top").alias("_i", "t")).select(
        "algorithm", "id", "t.charge", "t.peptide", "t.raw_score", "t.score", "t.hyperscore",
        (F.col("_i") + 1).cast("int").alias("rank"))


def histogram_of(states: DataFrame) -> DataFrame:
    """(algorithm, id, bin, n); the rows stay where their spectrum is."""
    return states.select("algorithm", "id", F.explode("counts").alias("c")).groupBy(
        "algorithm", "id", F.col("c.bin").alias("bin")).agg(F.sum("c.n").alias("n"))


def survival_counts(histogram: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Scores at or above each bin, less the last bin; the last bin keeps its own count.

    All bins from 0 on take part, also those without a score.  The histogram is
    read once: the gaps are filled in the spectrum's row.  Columns to carry have
    one value per spectrum.
    """
    keys = [c for c in histogram.columns if c not in ("bin", "n", *carry)]
    listed = histogram.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("_l"), *[F.first(c).alias(c) for c in carry])
    gap = lambda p, i: p.bin - F.coalesce(F.get("_l", i - 1).bin, F.lit(-1)) - 1
    every = F.flatten(F.transform("_l", lambda p, i: F.concat(
        F.array_repeat(F.lit(0).cast("long"), gap(p, i)), F.array(p.n))))
    rows = listed.select(
        *keys, *carry, F.element_at("_l", -1).bin.alias("_last"), F.element_at("_l", -1).n.alias("_tail"),
        F.posexplode(every).alias("bin", "n"))
    above = F.sum("n").over(W.partitionBy(*keys).orderBy(F.desc("bin")))
    return rows.withColumn("survivors", F.when(F.col("bin") == F.col("_last"), F.col("n")).otherwise(
        above - F.col("_tail"))).select(*keys, *carry, "bin", "n", "survivors")


def expectation_fit(histogram: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per spectrum: slope and intercept of log10(survivors) against the bin."""
    keys = [c for c in histogram.columns if c not in ("bin", "n", *carry)]
    survivors = survival_counts(histogram, carry).withColumn("_top", F.max(
        F.when(F.col("bin") == 0, F.col("survivors"))).over(W.partitionBy(*keys)))
    used = F.col("survivors").between(
        FIT_MIN_SURVIVORS, (0.5 + F.col("_top") / 2.0).cast("int"))
    y = F.when(used, F.log10("survivors"))
    x = F.when(used, F.col("bin").cast("double"))
    fit = survivors.groupBy(*keys).agg(
        F.sum("n").alias("n_scores"),
        F.regr_slope(y, x).alias("_slope"), F.regr_intercept(y, x).alias("_intercept"),
        *[F.first(c).alias(c) for c in carry])
    few = F.col("n_scores") < FIT_MIN_COUNT
    finite = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))
    return fit.select(
        *keys, *carry, "n_scores",
        F.when(few, DEFAULT_SLOPE).otherwise(finite("_slope")).alias("slope"),
        F.when(few, DEFAULT_INTERCEPT).otherwise(finite("_intercept")).alias("intercept"))


def expectation(psm: DataFrame) -> DataFrame:
    """Best and next match per spectrum with the expectation value of the best.

    Takes scored pairs or states; either is read once, as the matches go with the counts until the line is fitted.
    """
    states = psm if "counts" in psm.columns else spectrum_states(psm, 2)
    counts = states.select("algorithm", "id", "top", F.explode("counts").alias("c")).groupBy(
        "algorithm", "id", F.col("c.bin").alias("bin")).agg(F.sum("c.n").alias("n"), F.first("top").alias("top"))
    pick = lambda i, c: F.get("top", F.lit(i))[c].alias(f"{('best', 'next')[i]}_{c}")
    out = expectation_fit(counts, ("top",)).select(
        "algorithm", "id", *[pick(i, c) for i in (0, 1) for c in ("peptide", "hyperscore")],
        "n_scores", "slope", "intercept").withColumn("expect", F.pow(
            F.lit(10.0), F.col("intercept") + F.col("slope") * BIN_FACTOR * F.col("best_hyperscore")))
    return out if "algorithm" in psm.columns else out.drop("algorithm")
