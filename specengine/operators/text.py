"""Word counts, word statistics, letter variants and the most similar line."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specengine.functions.arrays import let
from specengine.functions.text import regularize_word
from specengine.operators.editdistance import PackedLines
from specengine.session import shuffle_partitions

LINE_REACH = 200


def words(lines: DataFrame, column: str = "text") -> DataFrame:
    """One row per word: split on blanks, upper-case letters only, empty words dropped."""
    return lines.select(F.explode(F.split(column, r"\s+")).alias("w")).select(
        regularize_word(F.col("w")).alias("word")).filter(F.col("word") != "")


def word_count(lines: DataFrame, column: str = "text") -> DataFrame:
    return words(lines, column).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def word_stats(lines: DataFrame, column: str = "text") -> DataFrame:
    """Words, letters, mean/deviation/longest of words and lines in one pass.

    Each line is first reduced to its own sums, so the aggregation sees one
    row per line.
    """
    lengths = F.transform(
        F.filter(F.transform(F.split(column, r"\s+"), regularize_word), lambda w: w != ""),
        lambda w: F.length(w).cast("long"))
    total = lambda a, f: F.aggregate(a, F.lit(0).cast("long"), f)
    per_line = lines.select(
        F.length(column).cast("long").alias("line"), lengths.alias("l")
    ).select(
        "line", F.size("l").cast("long").alias("n"),
        total("l", lambda t, x: t + x).alias("s"),
        total("l", lambda t, x: t + x * x).alias("q"),
        F.array_max("l").alias("m"))
    df = per_line.agg(
        F.sum("n").alias("words"), F.sum("s").alias("letters"), F.sum("q").alias("_q"),
        F.max("m").alias("longest_word"),
        F.count(F.lit(1)).alias("lines"), F.sum("line").alias("line_letters"),
        F.sum(F.col("line") * F.col("line")).alias("_lq"), F.max("line").alias("longest_line"))
    sd = lambda q, s, n: F.sqrt((F.col(q) - F.col(s) * F.col(s) / F.col(n))
                                / (F.col(n) - 1))
    return df.select(
        "words", "letters", (F.col("letters") / F.col("words")).alias("mean_word"),
        sd("_q", "letters", "words").alias("sd_word"), "longest_word",
        "lines", (F.col("line_letters") / F.col("lines")).alias("mean_line"),
        sd("_lq", "line_letters", "lines").alias("sd_line"), "longest_line")


def case_variant_count(lines: DataFrame, k: int = 3, column: str = "text") -> DataFrame:
    """All upper/lower case variants of every k-letter substring, counted.

    Substrings are counted before the 2^k variants are made, so the explosion
    works on distinct substrings.  A text is cut into letters once: `substring`
    reads it from its start, which is quadratic in a long text.
    """
    text = F.regexp_replace(F.lower(F.col(column)), r"[^\p{L}]", "")
    grams = lines.select(text.alias("t")).filter(F.length("t") >= k).select(F.explode(
        let(F.split("t", ""), lambda letters: F.transform(
            F.sequence(F.lit(0), F.length("t") - k),
            lambda i: F.concat(*[F.get(letters, i + j) for j in range(k)])))).alias("gram"))
    counted = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    letter = lambda mask, i: F.when(
        mask.bitwiseAND(1 << i) > 0, F.upper(F.substring("gram", i + 1, 1))
    ).otherwise(F.substring("gram", i + 1, 1))
    return counted.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << k) - 1)))).select(
        F.concat(*[letter(F.col("mask"), i) for i in range(k)]).alias("variant"), "n")


def _best_of_block(lines: list[tuple], reach: int) -> Iterator[tuple]:
    """(chapter, line_no, other, similarity) of the best match of each line within one block's pairs.

    `lines` (chapter, line_no, is_first, length, lowered line) are in order of
    their number; each is compared with the block's own lines that come up to
    `reach` before it.  A missing line has the similarity -1 to others, as
    `levenshtein_similarity` is NULL there, but for an empty one.
    """
    best: dict[int, tuple[float, int]] = {}
    waiting, packed, near = deque(), PackedLines(), deque()

    def meet(i: int, j: int, similarity: float) -> None:
        for own, other in ((i, j), (j, i)):
            found = (similarity, -lines[other][1])
            if own not in best or found > best[own]:
                best[own] = found

    for j, (_, number, is_first, length, line) in enumerate(lines):
        while waiting and lines[waiting[0]][1] < number:
            near.append(i := waiting.popleft())
            packed.add(lines[i][4] or "")
        while near and lines[near[0]][1] < number - reach:
            near.popleft()
            packed.drop()
        if near:
            for i, distance in zip(near, packed.distances(line or "").tolist()):
                lengths = [n for n in (length, lines[i][3]) if n is not None]
                longest = max(lengths, default=None)
                meet(i, j, 1.0 if longest == 0 else -1.0 if len(lengths) < 2 else (longest - distance) / longest)
        if is_first:
            waiting.append(j)
    for i, (similarity, other) in best.items():
        yield lines[i][0], lines[i][1], -other, similarity


def best_line_match(lines: DataFrame, reach: int = LINE_REACH) -> DataFrame:
    """For each line the most similar other line of its chapter, at most `reach` lines away.

    Lines are cut into blocks of `reach` numbers; a line meets the lines before
    it in its own and in the block before, so a chapter of any length spreads
    over many tasks and each pair is compared once, for both lines.  A line is
    compared with all that it meets at once, and a block hands on the best
    match of each of its lines only.  The number of partitions is fixed, as a
    line is cheap to move and costly to compare.  Among equal similarities the
    earlier line wins.
    """
    own = F.floor(F.col("line_no") / reach).cast("long")
    placed = lines.select(
        "chapter", "line_no", F.length("line").alias("_length"), F.lower("line").alias("_line"), own.alias("_own"),
        F.explode(F.array(own, own - 1)).alias("_b"))
    rows = placed.repartition(shuffle_partitions(lines), "chapter", "_b").sortWithinPartitions("chapter", "_b", "line_no").select(
        "chapter", "_b", "line_no", (F.col("_own") == F.col("_b")).alias("_first"), "_length", "_line")
    chapter, number = (lines.schema[c].dataType.simpleString() for c in ("chapter", "line_no"))

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []
        out: list[tuple] = []

        def rows_of() -> Iterator[tuple]:
            for batch in batches:
                kinds[:] = [batch.schema.field(i).type for i in (0, 2)]
                yield from zip(*(c.to_pylist() for c in batch.columns))

        for _, block in groupby(rows_of(), key=lambda r: r[:2]):
            members = [(r[0], *r[2:]) for r in block]
            if len(members) > 1:
                out.extend(_best_of_block(members, reach))
            if len(out) >= 10_000:
                yield table(out, kinds)
                out = []
        if out:
            yield table(out, kinds)

    def table(out: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
        columns = zip(*out)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (kinds[0], kinds[1], kinds[1], pa.float64()))],
            ["chapter", "line_no", "other", "similarity"])

    return rows.mapInArrow(
        matched, f"chapter {chapter}, line_no {number}, other {number}, similarity double").groupBy("chapter", "line_no").agg(
        F.max(F.struct("similarity", (-F.col("other")).alias("o"))).alias("b")
    ).select("chapter", "line_no", (-F.col("b.o")).alias("best_line_no"),
             F.when(F.col("b.similarity") >= 0, F.col("b.similarity")).alias("similarity"))
