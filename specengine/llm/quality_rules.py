"""Quality rules whose thresholds adapt to each language and source.

Counts of every whole text come from one pass.  Four whole-number rates of a document (hundredths of a
character per word, per mille of symbols, doubled lines and repeated words) go into mergeable quantile
sketches: a histogram whose bucket keeps the 7 leading bits of a value, so a quantile is off by 1/64 at
most.  Sketches of tasks add up in the shuffle, those of a language's sources to the language's, and
these to the one of all documents; a group of fewer than MIN_GROUP documents takes the next larger one.
A sketch has at most some thousand buckets, whatever the number of documents.

A rate passes up to UPPER quantile + SPREADS * (UPPER - median) + SLACK (word length also downwards).
Documents are joined with their group's limits; that table is broadcast only if it is counted and small.

Words in repeated windows and equal lines are found by 64-bit hashes of their bytes.

Defined cases: null text has no words and base_failed; null lang or source are groups of their own;
a text without a line or word has rates 0; repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from specengine.llm.common import (
    U, add_columns, chunks, mix, powers, small_or_shuffled, span_hashes, spans, stored, utf8, words,
)

REPEAT_WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
MIN_GROUP = 300
UPPER, LOWER, SPREADS = 0.75, 0.25, 8
#: Added to the limits: hundredths of a character, and per mille of words or lines.
SLACK = {"word_length": 100, "symbols": 50, "dup_lines": 400, "repeats": 250}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_row(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(mask)))
    return sums[at[1:]] - sums[at[:-1]]


def _repeated_words(word: np.ndarray, row: np.ndarray, rows: int, size: int) -> np.ndarray:
    """Words per row that lie in a window of `size` words found twice or more in the row."""
    if len(word) < size:
        return np.zeros(rows, np.int64)
    up, down = powers(len(word))
    sums = np.concatenate(([U(0)], np.cumsum(word * up[:len(word)])))
    begin = np.flatnonzero(row[:-size + 1] == row[size - 1:])
    if len(begin) == 0:
        return np.zeros(rows, np.int64)
    key = mix((sums[begin + size] - sums[begin]) * down[begin] + mix(row[begin].astype(U)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    found = begin[order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]]
    change = np.zeros(len(word) + 1, np.int64)
    np.add.at(change, found, 1)
    np.add.at(change, found + size, -1)
    return np.bincount(row[np.cumsum(change[:-1]) > 0], minlength=rows)


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    data, at = utf8(column)
    rows = len(at) - 1
    start, end, row = words(data, at)
    in_word = np.zeros(len(data) + 1, np.int8)
    in_word[start] += 1
    in_word[end] -= 1
    in_word = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool) if len(data) else np.zeros(0, bool)
    # A word that ends where the next row's first word starts leaves +1 - 1 = 0 there: still inside.
    begin, stop, of = spans(data != 10, at)
    before = np.concatenate(([0], np.cumsum(in_word)))
    full = before[stop] > before[begin]
    begin, stop, of = begin[full], stop[full], of[full]
    lines = np.bincount(of, minlength=rows)
    kinds, first = np.unique(span_hashes(data, begin, stop) + mix(of.astype(U)), return_index=True)
    return {
        "n_words": np.bincount(row, minlength=rows),
        "word_chars": _per_row(in_word & ((data & 0xC0) != 0x80), at),
        "n_symbols": _per_row(_SYMBOL[data], at),
        "n_lines": lines,
        "n_dup_lines": lines - np.bincount(of[first], minlength=rows),
        "n_repeat_words": _repeated_words(span_hashes(data, start, end), row, rows, REPEAT_WINDOW),
    }


def with_counts(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """docs with COUNTS, and without the text unless it is wanted."""
    schema = StructType([f for f in docs.schema.fields if keep_text or f.name != "text"])
    for name in COUNTS:
        schema = schema.add(name, LongType())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = counts(batch.column(batch.schema.get_field_index("text")))
            yield add_columns(batch, () if keep_text else ("text",),
                              **{k: found[k].astype(np.int64) for k in COUNTS})

    return docs.mapInArrow(step, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rates() -> dict[str, Column]:
    per_word = F.greatest("n_words", F.lit(1))
    return {
        "word_length": F.floor(100 * F.col("word_chars") / per_word),
        "symbols": F.floor(1000 * F.col("n_symbols") / per_word),
        "dup_lines": F.floor(1000 * F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        "repeats": F.floor(1000 * F.col("n_repeat_words") / per_word),
    }


def sketch_bucket(value: Column) -> Column:
    """Leading 7 bits and exponent of a whole number: ordered as the numbers are."""
    exponent = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", exponent, F.lit(7)) + F.call_function("shiftright", value, exponent)


def bucket_top(bucket: Column) -> Column:
    """The largest number of a bucket."""
    exponent = F.call_function("shiftright", bucket, F.lit(7)).cast("int")
    return F.call_function("shiftleft", F.pmod(bucket, F.lit(128)) + 1, exponent) - 1


def sketches(counted: DataFrame, group: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(level, group columns, rate, bucket, n); level 0 is the group, the last one all documents."""
    rows = counted.filter(~base_failed()).select(*group, F.explode(F.array(*[
        F.struct(F.lit(name).alias("rate"), sketch_bucket(value.cast("long")).alias("bucket"))
        for name, value in rates().items()])).alias("r"))
    own = rows.groupBy(*group, "r.rate", "r.bucket").agg(F.count(F.lit(1)).alias("n"))
    own = stored(own, "sketches")
    out = own.withColumn("level", F.lit(0))
    for level in range(1, len(group) + 1):
        keep = group[:len(group) - level]
        merged = own.groupBy(*keep, "rate", "bucket").agg(F.sum("n").alias("n"))
        out = out.unionByName(merged.withColumn("level", F.lit(level)), allowMissingColumns=True)
    return out


def limits(counted: DataFrame, group: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per level and group: documents, and the lowest and highest value of every rate that passes."""
    keys = ["level", *group, "rate"]
    upto = W.partitionBy(*keys).orderBy("bucket")  # a sketch's buckets
    rows = sketches(counted, group).withColumn("upto", F.sum("n").over(upto)).withColumn(
        "all", F.sum("n").over(W.partitionBy(*keys)))

    def quantile(q: float) -> Column:
        return F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), bucket_top(F.col("bucket"))))

    slack = F.element_at(F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv]), F.col("rate"))
    by_rate = rows.groupBy(*keys).agg(
        F.first("all").alias("all"), quantile(LOWER).alias("low"), quantile(0.5).alias("mid"),
        quantile(UPPER).alias("high")).withColumns({
            "highest": F.col("high") + SPREADS * (F.col("high") - F.col("mid")) + slack,
            "lowest": F.col("low") - SPREADS * (F.col("mid") - F.col("low")) - slack})
    return by_rate.groupBy("level", *group).agg(
        F.first("all").alias("docs"),
        *[F.max(F.when(F.col("rate") == r, F.col(edge))).alias(f"{r}_{edge}")
          for r in SLACK for edge in ("lowest", "highest")])


def judge(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """docs with COUNTS, base_failed and kept."""
    group = ("lang", "source")
    counted = with_counts(docs, keep_text)
    counted = stored(counted, "counts")
    table = stored(limits(counted, group), "limits")
    edges = [f"{r}_{e}" for r in SLACK for e in ("lowest", "highest")]
    out = counted
    for level in range(len(group) + 1):
        names = group[:len(group) - level]
        side = table.filter((F.col("level") == level) & (F.col("docs") >= (MIN_GROUP if names else 0))).select(
            *[F.col(g).alias(f"_{g}{level}") for g in names], *[F.col(e).alias(f"_{e}{level}") for e in edges])
        on = [F.col(g).eqNullSafe(F.col(f"_{g}{level}")) for g in names]
        out = out.join(small_or_shuffled(side) if on else F.broadcast(side), on or F.lit(True), "left")

    def edge(name: str) -> Column:
        return F.coalesce(*[F.col(f"_{name}{level}") for level in range(len(group) + 1)])

    passes = F.lit(True)
    for name, value in rates().items():
        passes = passes & F.coalesce(value <= edge(f"{name}_highest"), F.lit(True))
    passes = passes & F.coalesce(rates()["word_length"] >= edge("word_length_lowest"), F.lit(True))
    return out.select(*counted.columns, base_failed().alias("base_failed"), (~base_failed() & passes).alias("kept"))
