"""String expressions for the text jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """(longest - distance) / longest on lower-cased text; 1.0 when both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    distance = F.levenshtein(F.lower(a), F.lower(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(
        (longest - distance).cast("double") / longest
    )


def regularize_word(word: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(word)), r"[^\p{L}]", "")


def sorted_letters(word: Column) -> Column:
    return F.array_join(F.array_sort(F.split(word, "")), "")


def first_name(name: Column) -> Column:
    return F.split(F.trim(name), r"\s+").getItem(0)


def last_name(name: Column) -> Column:
    return F.element_at(F.split(F.trim(name), r"\s+"), -1)
