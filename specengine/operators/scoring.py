"""Scoring of spectra against the peptides of their mass window.

Each algorithm prepares the measured side once per spectrum: a sorted axis, the
values on it and a few numbers.  Spectra and peptides meet in blocks of the
mass axis that hold a bounded number of pairs.  A block makes the theory once
per peptide and scores a spectrum against a run of peptides at a time, so pairs
are never shuffled: a block hands on the scored pairs, or per spectrum its best
matches and score histogram only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specengine.functions.masses import residue_table
from specengine.operators import condition as C
from specengine.operators import kernels as K
from specengine.operators import psm as P
from specengine.operators.blocks import PAIRS_PER_BLOCK, ROWS_PER_BLOCK, mass_blocks, place
from specengine.operators.joins import Window, add_precursor_mass
from specengine.operators.mods import residue_masses
from specengine.operators.skew import salted_join
from specengine.session import shuffle_partitions, store

# Scores are rounded, so that equal ones tie whatever the order of their sums.
SCORE_DIGITS = 6
#: Pairs that a block scores at a time.
BATCH_PAIRS = 1 << 20
#: Peptides of a block whose ions are held at a time.
SLICE_PEPTIDES = 8_192
#: Pairs of a block that hands on states, one per spectrum and slice, or totals only: they are scored in batches, and
#: fewer blocks copy fewer rows.  Totals take no room, so there the rows of a block are its only limit.
PAIRS_PER_STATE_BLOCK = ROWS_PER_BLOCK * SLICE_PEPTIDES
PAIRS_PER_TOTALS_BLOCK = ROWS_PER_BLOCK**2
ROWS = ("algorithm string, id {id}, charge int, peptide string, raw_score double, score double, hyperscore double")
TOTALS = "algorithm string, id {id}, charge int, n bigint, raw_total double, raw_best double, best double"


class Algorithm(NamedTuple):
    """How spectra are measured, as (id, axis, value, extra), and the kernel that scores them."""

    measure: Callable[[DataFrame], DataFrame]
    kernel: Callable[..., tuple[np.ndarray, ...]]


def _sparse(rows: DataFrame, index: str, value: str) -> DataFrame:
    """(id, axis, value, extra) from one row per id and index."""
    listed = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(
        F.col(index).cast("double").alias("x"), F.col(value).alias("v")))).alias("_l"))
    return listed.select(
        "id", F.transform("_l", lambda p: p.x).alias("axis"), F.transform("_l", lambda p: p.v).alias("value"),
        F.array().cast("array<double>").alias("extra"))


def _peaks(df: DataFrame, *extra: Column) -> DataFrame:
    return df.select(
        "id", F.transform("measured", lambda p: p.mz).alias("axis"),
        F.transform("measured", lambda p: p.intensity).alias("value"), F.array(*extra).alias("extra"))


def _kscore_measure(spectra: DataFrame) -> DataFrame:
    good = C.condition_spectra(spectra, C.Settings(isotope_mz=150.0))
    return _sparse(C.sliding_mean_subtract(C.k_sqrt_window_normalize(good)), "k", "intensity")


def _tandem_measure(spectra: DataFrame) -> DataFrame:
    good = C.condition_spectra(spectra)
    index = (F.col("mz") / F.lit(K.TANDEM_WIDTH) + 0.5).cast("int")
    return _sparse(C.explode_peaks(good).groupBy("id", index.alias("k")).agg(
        F.sum("intensity").alias("intensity")), "k", "intensity")


def _comet_measure(spectra: DataFrame) -> DataFrame:
    good = spectra.filter(F.size("peaks") >= 5)
    return _sparse(C.comet_bin_weights(C.explode_peaks(
        good.withColumn("peaks", C.comet_normalize(F.col("peaks"))))), "bin", "weight")


def _morpheus_measure(spectra: DataFrame) -> DataFrame:
    return _peaks(spectra.filter(F.size("peaks") > 0).withColumn(
        "measured", C.morpheus_shift(F.col("peaks"), F.col("precursor.charge"))),
        C.spectrum_stats(F.col("peaks"))["sum_intensity"])


def _probid_measure(spectra: DataFrame) -> DataFrame:
    return _peaks(
        spectra.filter(F.size("peaks") > 0).withColumn("measured", C.probid_normalize(C.probid_truncate(F.col("peaks")))),
        F.aggregate("measured", F.lit(0.0), lambda t, p: t + F.log(p.intensity)),
        F.element_at("measured", -1).mz - F.get("measured", F.lit(0)).mz)


ALGORITHMS: dict[str, Algorithm] = {
    "kscore": Algorithm(_kscore_measure, K.kscore_batch),
    "tandem": Algorithm(_tandem_measure, K.tandem_batch),
    "comet": Algorithm(_comet_measure, K.comet_batch),
    "morpheus": Algorithm(_morpheus_measure, K.morpheus_batch),
    "probid": Algorithm(_probid_measure, K.probid_batch),
    "sequest": Algorithm(_probid_measure, K.probid_batch),
}
DEFAULT_ALGORITHM = "kscore"


def choose_algorithm(name: str | None = None) -> Algorithm:
    try:
        return ALGORITHMS[(name or DEFAULT_ALGORITHM).lower()]
    except KeyError:
        raise ValueError(f"unknown scoring algorithm {name!r}; one of {sorted(ALGORITHMS)}")


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks()
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]], at - at[0]


_MASSES = np.zeros(256, np.int64)
for _letter, _nano in residue_table().items():
    _MASSES[ord(_letter)] = _nano


def _residues(right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masses, offsets and letters of the residues of all peptides; modifications are added to their places.

    The sequence may be missing where it is the peptide's name, and the masses where the letters tell them.
    """
    names = right.column("mod_sequence").combine_chunks()
    sequences = pc.coalesce(right.column("sequence").combine_chunks(), names)
    letters = np.frombuffer("".join(sequences.to_pylist()).encode("ascii", "replace"), np.uint8)
    if "residues" in right.column_names:
        return *_flat(right.column("residues")), letters
    at = np.append(0, np.cumsum(pc.utf8_length(sequences).to_numpy(zero_copy_only=False).astype(np.int64)))
    residues = _MASSES[letters]
    if "mods" in right.column_names:
        mods = right.column("mods").combine_chunks()
        size = pc.fill_null(pc.list_value_length(mods), 0).to_numpy(zero_copy_only=False)
        flat = mods.flatten()
        position = flat.field("pos").to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.repeat(at[:-1], size) + position - 1
        inside = (position > 0) & (place < np.repeat(at[1:], size))
        np.add.at(residues, place[inside], flat.field("nano").to_numpy(zero_copy_only=False).astype(np.int64)[inside])
    return residues, at, letters


_NO_ROWS = tuple(np.zeros(0, t) for t in (int, int, float, float, float))


def _rounded(x: np.ndarray) -> np.ndarray:
    """Half away from zero."""
    return np.copysign(np.floor(np.abs(x) * 10.0**SCORE_DIGITS + 0.5) / 10.0**SCORE_DIGITS, x)


def _batches(size: np.ndarray, peaks: np.ndarray, chosen: np.ndarray) -> list[np.ndarray]:
    """The chosen spectra in batches of bounded pairs and hits."""
    effort = np.cumsum((size * (1 + peaks // 8))[chosen])
    return np.split(chosen, np.flatnonzero(np.diff(effort // BATCH_PAIRS)) + 1) if len(chosen) else []


def _scored(name: str, window: Window, positive: bool, carried: int | None, above: float | None = None,
            totals: bool = False) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What a block does: all scored pairs (those of a hyperscore `above`), or of its spectra, one per slice of peptides, `totals` or with `carried` states."""
    kernel = choose_algorithm(name).kernel

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pa.array(np.argsort(right.column("matching_mass").to_numpy(), kind="stable")))
        masses = right.column("matching_mass").to_numpy()
        residues, at, letters = _residues(right)
        rank = P.ranks(right.column("mod_sequence")) if carried else None
        axes, axis_at = _flat(left.column("axis"))
        values, _ = _flat(left.column("value"))
        extras, extra_at = _flat(left.column("extra"))
        extras = extras.reshape(left.num_rows, -1) if len(extras) else np.zeros((left.num_rows, 0))
        scan, charge = left.column("precursor_mass").to_numpy(), left.column("charge").to_numpy()
        first = np.searchsorted(masses, scan - window.below * (1 + 1e-9))
        last = np.searchsorted(masses, scan + window.above * (1 + 1e-9), "right")
        peaks, found = np.diff(axis_at), []
        for start in range(0, right.num_rows, SLICE_PEPTIDES):
            end = min(start + SLICE_PEPTIDES, right.num_rows)
            edges = at[start:end + 1]
            peptides = K.Peptides(residues[edges[0]:edges[-1]], edges - edges[0], letters[edges[0]:edges[-1]])
            low, high = np.clip(first, start, end) - start, np.clip(last, start, end) - start
            for cap, chosen in ((1, charge == 1), (2, charge != 1)):
                for own in _batches(high - low, peaks, np.flatnonzero(chosen & (high > low))):
                    place, _ = K.ranges(axis_at[own], axis_at[own + 1])
                    spectra = K.Spectra(np.append(0, np.cumsum(peaks[own])), axes[place], values[place], extras[own])
                    pairs = K.Pairs(low[own], high[own])
                    at_, raw, scores, hyper = kernel(spectra, pairs, peptides, cap, positive)
                    spectrum, peptide = pairs.of(at_)
                    spectrum, peptide = own[spectrum], start + peptide
                    raw, scores, hyper = _rounded(raw), _rounded(scores), _rounded(hyper)
                    keep = window.keeps(scan[spectrum], charge[spectrum], masses[peptide])
                    if positive:
                        keep &= scores > 0
                    if above is not None:
                        keep &= hyper > above
                    rows = tuple(c[keep] for c in (spectrum, peptide, raw, scores, hyper))
                    found.append(states(*rows, left, right, rank) if carried else summed(*rows, left) if totals else rows)
        if totals:
            return pa.concat_tables(found or [summed(*_NO_ROWS, left)])
        if carried:
            return pa.concat_tables(found or [states(*_NO_ROWS, left, right, rank)])
        return named(*(np.concatenate(c) for c in zip(*(found or [_NO_ROWS]))), left, right)

    def named(spectrum: np.ndarray, peptide: np.ndarray, raw: np.ndarray, scores: np.ndarray, hyper: np.ndarray,
              left: pa.Table, right: pa.Table) -> pa.Table:
        scans = left.select(["id", "charge"]).take(pa.array(spectrum))
        return pa.table({
            "algorithm": pa.array([name], pa.string()).take(pa.array(np.zeros(len(raw), int))), "id": scans.column("id"),
            "charge": scans.column("charge"), "peptide": right.column("mod_sequence").take(pa.array(peptide)),
            "raw_score": raw, "score": scores, "hyperscore": hyper})

    def summed(spectrum: np.ndarray, peptide: np.ndarray, raw: np.ndarray, scores: np.ndarray, hyper: np.ndarray,
               left: pa.Table) -> pa.Table:
        begin = np.flatnonzero(np.append(True, spectrum[1:] != spectrum[:-1])[:len(spectrum)])
        scans = left.select(["id", "charge"]).take(pa.array(spectrum[begin]))
        of = lambda fold, x: fold.reduceat(x, begin) if len(begin) else x
        return pa.table({
            "algorithm": pa.array([name] * len(begin), pa.string()), "id": scans.column("id"), "charge": scans.column("charge"),
            "n": np.diff(np.append(begin, len(spectrum))).astype(np.int64), "raw_total": of(np.add, raw),
            "raw_best": of(np.maximum, raw), "best": of(np.maximum, scores)})

    def states(spectrum: np.ndarray, peptide: np.ndarray, raw: np.ndarray, scores: np.ndarray, hyper: np.ndarray,
               left: pa.Table, right: pa.Table, rank: np.ndarray) -> pa.Table:
        new = np.append(True, spectrum[1:] != spectrum[:-1])[:len(spectrum)]
        keys = pa.table({"algorithm": pa.array([name] * int(new.sum()), pa.string()),
                         "id": left.column("id").take(pa.array(spectrum[new]))})
        return P.states_of(keys, np.cumsum(new) - 1, hyper, rank[peptide], carried, lambda kept: named(
            spectrum[kept], peptide[kept], raw[kept], scores[kept], hyper[kept], left, right))

    return score


def _meet(spectra: DataFrame, library: DataFrame, window: Window, algorithm: str, positive: bool,
          carried: int | None, target: float | None, above: float | None = None, totals: bool = False) -> DataFrame:
    headers = add_precursor_mass(spectra).select(
        "id", F.col("precursor.charge").cast("int").alias("charge"), F.col("precursor_mass").cast("double").alias("precursor_mass"))
    headers = headers.filter(F.col("precursor_mass").isNotNull() & F.col("charge").isNotNull())
    if window.charges:
        headers = headers.filter(F.col("charge").isin(*window.charges))
    mods = [F.col("mods")] if "mods" in library.columns else []
    # A peptide goes to its blocks without what its letters tell.  Both sides are read twice, to be counted and to be placed.
    left = store(headers.join(choose_algorithm(algorithm).measure(spectra), "id"), "measured")
    right = store(library.filter(F.col("matching_mass").isNotNull() & (F.length("sequence") > 0)).select(
        "mod_sequence", F.when(F.col("sequence") != F.col("mod_sequence"), F.col("sequence")).alias("sequence"),
        F.col("matching_mass").cast("double").alias("matching_mass"),
        *mods), "peptides")
    blocks = mass_blocks(left, right, "precursor_mass", "matching_mass", window.below, window.above, target,
                         PAIRS_PER_STATE_BLOCK if carried else PAIRS_PER_TOTALS_BLOCK if totals else PAIRS_PER_BLOCK)
    mass = F.col("precursor_mass")
    left = place(left, blocks, mass - window.below, mass + window.above, True, "id")
    right = place(right, blocks, F.col("matching_mass"), F.col("matching_mass"), False, "mod_sequence")
    keys = ["block", "a", "b"]
    id_type = spectra.schema["id"].dataType.simpleString()
    schema = (P.STATES if carried else TOTALS if totals else ROWS).format(id=id_type)
    # A block is few bytes and much work: the number of partitions is fixed, or adaptive execution merges them by bytes.
    n = shuffle_partitions(left)
    return left.repartition(n, *keys).groupBy(*keys).cogroup(right.repartition(n, *keys).groupBy(*keys)).applyInArrow(
        _scored(algorithm, window, positive, carried, above, totals), schema)


def score_spectra(spectra: DataFrame, library: DataFrame, window: Window, algorithm: str = DEFAULT_ALGORITHM,
                  positive: bool = True, target: float | None = None, above: float | None = None) -> DataFrame:
    """All scored pairs: algorithm, id, charge, peptide and the three scores.

    `target` fixes the pairs of a block; by default they follow the number of partitions, within limits.
    With `above` a block hands on only the pairs whose hyperscore is larger.
    """
    return _meet(spectra, library, window, algorithm, positive, None, target, above)


def score_totals(spectra: DataFrame, library: DataFrame, window: Window, algorithm: str = DEFAULT_ALGORITHM,
                 target: float | None = None) -> DataFrame:
    """Per spectrum its scored pairs (positive scores) counted: algorithm, id, charge, n, raw_total, raw_best, best.

    Every pair is scored; the blocks add up their pairs and don't hand them on.
    """
    parts = _meet(spectra, library, window, algorithm, True, None, target, totals=True)
    return parts.groupBy("algorithm", "id", "charge").agg(
        F.sum("n").alias("n"), F.sum("raw_total").alias("raw_total"), F.max("raw_best").alias("raw_best"),
        F.max("best").alias("best"))


def match_states(spectra: DataFrame, library: DataFrame, window: Window, algorithm: str = DEFAULT_ALGORITHM,
                 carried: int = P.CARRIED_MATCHES, target: float | None = None) -> DataFrame:
    """One row per spectrum with a positive score: its best matches and score histogram."""
    return P.merged_states(_meet(spectra, library, window, algorithm, True, carried, target), carried)


def multi_score(spectra: DataFrame, library: DataFrame, window: Window, algorithms: list[str],
                carried: int = P.CARRIED_MATCHES) -> DataFrame:
    """States of several algorithms, told apart by the `algorithm` column."""
    out = None
    for name in algorithms:
        part = match_states(spectra, library, window, name, carried)
        out = part if out is None else out.unionByName(part)
    return out


# ---- ion use of the matches that are kept ----------------------------------

USED = (("b_count", "integer"), ("y_count", "integer"), ("b_score", "double"), ("y_score", "double"),
        ("matched_peaks", "integer"))


def _used(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Counts and scores of b and y for the matches of a batch (charge, residues, axis, value)."""
    residues, at = _flat(pa.chunked_array([batch.column("residues")]))
    axis, axis_at = _flat(pa.chunked_array([batch.column("axis")]))
    values, _ = _flat(pa.chunked_array([batch.column("value")]))
    charge = batch.column("charge").to_numpy(zero_copy_only=False)
    out = np.zeros((4, batch.num_rows))
    for cap, chosen in ((1, charge == 1), (2, charge != 1)):
        own = np.flatnonzero(chosen & (np.diff(at) > 0))
        place, _ = K.ranges(at[own], at[own + 1])
        offsets = np.append(0, np.cumsum(np.diff(at)[own]))
        peaks, row = K.ranges(axis_at[own], axis_at[own + 1])
        for i, found in enumerate(K.ion_use(K.Peptides(residues[place], offsets, np.zeros(0, np.uint8)), cap,
                                            row, axis[peaks], values[peaks])):
            out[i, own] = found
    return [*out[:2].astype(np.int32), *out[2:], (out[0] + out[1]).astype(np.int32)]


def ion_use(matches: DataFrame, vectors: DataFrame, library: DataFrame) -> DataFrame:
    """Add b/y counts and scores to K-score matches.

    Runs after the best matches are chosen, so it joins a few rows per
    spectrum, not all pairs.  Matches and their peptides are read several times
    and stored first: as one plan the whole search would be in it each time.
    A match takes its peptide's sequence along and the ions are made in the
    Python step, so neither ions nor spectra are shuffled with it.  `vectors`
    has (id, axis, value), or (id, vector) with the index as position.
    """
    matches = store(matches, "matches")
    of_mods = ["mods"] if "mods" in library.columns else []
    kept = store(library.join(
        matches.select(F.col("peptide").alias("mod_sequence")).distinct(), "mod_sequence", "left_semi").select(
        F.col("mod_sequence").alias("peptide"), F.col("sequence").alias("_sequence"),
        *[F.col(c).alias("_mods") for c in of_mods]), "kept")
    # A peptide that many spectra match is cut into parts.
    joined = salted_join(matches, kept, ["peptide"], sized_by=(matches.select("peptide"), kept.select("peptide")))
    if "axis" not in vectors.columns:
        vectors = vectors.select("id", *[F.transform(F.filter(F.transform(
            "vector", lambda v, k: F.struct(k.cast("double").alias("axis"), v.alias("value"))), lambda p: p.value != 0),
            lambda p: p[c]).alias(c) for c in ("axis", "value")])
    names = [c for c in joined.columns if c not in ("_sequence", "_mods")]
    rows = joined.join(vectors.select("id", "axis", "value"), "id").select(
        *names, F.col("charge").cast("int").alias("_charge"), F.col("axis").alias("_axis"), F.col("value").alias("_value"),
        residue_masses(F.col("_sequence"), F.col("_mods") if of_mods else None).alias("_residues"))

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.select([f"_{c}" for c in ("charge", "residues", "axis", "value")]).rename_columns(
                ["charge", "residues", "axis", "value"])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), *map(pa.array, _used(own))], [*names, *(n for n, _ in USED)])

    schema = rows.select(*names).schema
    for name, kind in USED:
        schema = schema.add(name, kind)
    return rows.mapInArrow(used, schema)
