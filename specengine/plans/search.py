"""The whole search: proteins and spectra to best matches, ion use and expectation."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specengine.functions.masses import precursor_mass
from specengine.operators import condition as C
from specengine.operators import joins as J
from specengine.operators import psm as P
from specengine.operators import scoring as S
from specengine.operators.library import build_library
from specengine.session import store


def limits_join(spectra: DataFrame, library: DataFrame, sized_by: J.SizedBy = None, sums: str | None = None) -> DataFrame:
    """Whole-mass lookup, then the exact mass limits; with `sums` pairs are counted and summed per id, not made."""
    if sums:
        return J.limit_sums(spectra, library, sums)
    pairs = J.mass_limit_join(spectra, library, sized_by=sized_by)
    return pairs.filter(J.within_limits(
        F.col("precursor_mass"), F.col("matching_mass"), F.col("precursor.charge")))


WINDOWS = {"bins": J.BINS, "limits": J.LIMITS, "dalton": J.dalton_window()}


def search(spectra: DataFrame, library: DataFrame, algorithm: str = S.DEFAULT_ALGORITHM,
           join: str = "bins", above: float | None = None) -> DataFrame:
    """All scored matches (positive scores, hyperscores `above`): algorithm, id, charge, peptide, three scores."""
    return S.score_spectra(spectra, library, WINDOWS[join], algorithm, above=above)


def search_states(spectra: DataFrame, library: DataFrame, algorithm: str = S.DEFAULT_ALGORITHM,
                  join: str = "bins", carried: int = P.CARRIED_MATCHES) -> DataFrame:
    """Per spectrum the best matches and the score histogram; pairs are scored once and not handed on."""
    return S.match_states(spectra, library, WINDOWS[join], algorithm, carried)


def search_report(spectra: DataFrame, library: DataFrame, join: str = "bins",
                  carried: int = P.CARRIED_MATCHES) -> DataFrame:
    """Ranked K-score matches with ion use, next score, expectation and masses.

    The states are stored once; only their carried matches are joined back to
    the library and the spectra.
    """
    good = C.condition_spectra(spectra, C.Settings(isotope_mz=150.0))
    states = store(search_states(spectra, library, "kscore", join, carried), "states")
    ranked = P.matches_of(states)
    fits = P.expectation_fit(P.histogram_of(states))
    used = S.ion_use(ranked, C.k_vectors(good), library)
    masses = library.select(F.col("mod_sequence").alias("peptide"),
                            F.col("matching_mass").alias("calc_mass"))
    parents = spectra.select("id", precursor_mass(
        F.col("precursor.mz"), F.col("precursor.charge")).alias("precursor_mass"))
    return used.join(fits, ["algorithm", "id"]).join(parents, "id").join(masses, "peptide").withColumn(
        "expect", F.pow(F.lit(10.0), F.col("intercept")
                        + F.col("slope") * P.BIN_FACTOR * F.col("hyperscore")))


def library_of(proteins: DataFrame, **settings) -> DataFrame:
    return build_library(proteins, **settings)


search_limits = partial(search, join="limits")
