"""Scan identifiers, retention times, score bins."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The logarithmic score axis of the discovery counts.
FDR_BINS = 3200
FDR_LOG_MIN, FDR_LOG_MAX = -8.0, 8.0
FDR_LOG_STEP = (FDR_LOG_MAX - FDR_LOG_MIN) / FDR_BINS
LINEAR_BINS = 100

MAX_FACTORIAL = 20


def scan_id_from_text(text: Column) -> Column:
    """The number after `scan=`; the text itself when there is none."""
    return F.when(
        text.contains("scan="), F.regexp_extract(text, r"scan=([^ ]*)", 1)
    ).otherwise(text)


def padded_scan_id(scan: Column) -> Column:
    return F.lpad(scan.cast("string"), 12, "0")


def rt_seconds(text: Column) -> Column:
    """`PT5.5S` or `5.5` to seconds, 0 when it is no number."""
    return F.coalesce(F.regexp_replace(text, r"^PT|S$", "").try_cast("double"), F.lit(0.0))


def fdr_bin(score: Column) -> Column:
    """Score to one of 3200 logarithmic bins over 1e-8 .. 1e8."""
    inner = ((F.log10(score) - F.lit(FDR_LOG_MIN)) / F.lit(FDR_LOG_STEP)).cast("int")
    return (
        F.when(score <= F.lit(10.0**FDR_LOG_MIN), 0)
        .when(score >= F.lit(10.0**FDR_LOG_MAX), FDR_BINS - 1)
        .otherwise(inner)
    )


def fdr_bin_score(bin_: Column) -> Column:
    """Lower score limit of a bin."""
    return (
        F.when(bin_ <= 0, F.lit(10.0**FDR_LOG_MIN))
        .when(bin_ >= FDR_BINS, F.lit(10.0**FDR_LOG_MAX))
        .otherwise(F.lit(10.0**FDR_LOG_MIN) * F.pow(F.lit(10.0), F.lit(FDR_LOG_STEP) * bin_))
    )


def linear_bin(score: Column) -> Column:
    """Whole-number bins 0..99."""
    return F.least(F.greatest(score.cast("int"), F.lit(0)), F.lit(LINEAR_BINS - 1))


def hconvert(score: Column, algorithm: str = "kscore") -> Column:
    """Hyperscore to the axis of the score histogram."""
    value = 0.05 * score if algorithm == "kscore" else 0.05 * F.log10(score)
    return F.when(score <= 0, F.lit(0.0)).otherwise(value)


def factorial(n: Column) -> Column:
    """n! as a double; counts above 20 go through the table of doubles as well."""
    table = F.array(*[F.lit(float(math.factorial(i))) for i in range(171)])
    return F.get(table, n.cast("int"))
