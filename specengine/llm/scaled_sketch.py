"""Document fingerprints: sketches that keep every shingle hash below a fixed fraction of all hashes.

A shingle is SHINGLE successive words (all words of a shorter text).  Two sketches of the same fraction
merge by union, and the share of one's hashes that the other has estimates how much of the first
document the second contains, however unequal the two are.  A text whose hashes all lie above the
fraction keeps its smallest one, so that only a text without words has an empty sketch.

Everything here is DataFrame functions: words are hashed once, a shingle's hash is made of its words'.

Each document meets the next one by id (`with_next`) through one shuffle of the rows: blocks of ids cut
at sampled bounds, a window inside a block, and the first row of the next block for a block's last row.
The bounds balance the blocks and don't change the result.  Rows without id come last, equal ids in the
order of their texts.

Defined cases: null text is empty; an empty sketch is like another empty one (1.0) and like no other
(0.0); a single document has no next one but itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specengine.functions.arrays import let
from specengine.llm.common import stored

SHINGLE = 5
#: One hash in FRACTION is kept.
FRACTION = 8
_BITS = 63


def word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def sketch(hashes: Column, size: int = SHINGLE, fraction: int = FRACTION) -> Column:
    """Sorted distinct hashes that the sketch keeps, of an array of word hashes."""
    top = (1 << _BITS) // fraction
    none = F.expr("cast(array() as array<bigint>)")

    def shingles(words: Column) -> Column:
        return F.when(F.size(words) == 0, none).otherwise(F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]).bitwiseAND((1 << _BITS) - 1)))

    def kept(every: Column) -> Column:
        low = F.array_sort(F.array_distinct(F.filter(every, lambda h: h < top)))
        return F.when(F.exists(every, lambda h: h < top), low).otherwise(
            F.filter(F.array(F.array_min(every)), lambda h: h.isNotNull()))

    return let(let(hashes, shingles), kept)


def as_text(kept: Column) -> Column:
    return F.array_join(F.transform(kept, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def containment(own: Column, other: Column) -> Column:
    """Estimated share of the first sketch's document that the second one contains."""
    shared = F.size(F.array_intersect(own, other))
    return F.when(F.size(own) == 0, (F.size(other) == 0).cast("double")).otherwise(shared / F.size(own))


def merge(own: Column, other: Column) -> Column:
    return F.array_sort(F.array_union(own, other))


def _block(bounds: list[int]) -> Column:
    """The number of bounds that aren't above the id; rows without id have a block of their own, the last."""
    below = F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda b: b <= F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(below)


def with_next(rows: DataFrame, made: dict[str, Callable[[Column], Column]],
              blocks: int | None = None) -> DataFrame:
    """rows of (doc_id, text) with next_text, and for every name in `made` its value of the text (as name) and
    of the next row's (as next_name).  The next row is that by doc_id, and the first after the last."""
    spark = rows.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / blocks for i in range(1, blocks)]
    bounds = rows.agg(F.percentile_approx("doc_id", shares, 1000)).first()[0] if shares else None
    bounds = sorted(set(bounds or []))
    placed = rows.withColumn("_block", _block(bounds))
    names = ["text", *made]

    # The first row of each block: the smallest id by ids alone, then the rows that have it.
    least = placed.groupBy("_block").agg(F.min("doc_id").alias("_least"))
    heads = placed.join(F.broadcast(least.withColumnRenamed("_block", "_of")), (F.col("_block") == F.col("_of"))
                        & F.col("doc_id").eqNullSafe(F.col("_least")))
    first = stored(heads.groupBy("_block").agg(F.min("text").alias("text")), "firsts")  # one row a block
    first = first.withColumns({k: fn(F.col("text")) for k, fn in made.items()}).select(
        "_block", F.struct(*names).alias("_v"))
    whole = W.orderBy("_block")
    after = first.select("_block", F.coalesce(F.lead("_v").over(whole), F.first("_v").over(
        whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("_after"))

    inside = W.partitionBy("_block").orderBy(F.col("doc_id").asc_nulls_last(), "text")
    led = placed.withColumns({k: fn(F.col("text")) for k, fn in made.items()}).withColumn(
        "_next", F.lead(F.struct(*names)).over(inside))
    # One row a block, and blocks are as many as shuffle partitions: small enough to broadcast.
    led = led.join(F.broadcast(after.withColumnRenamed("_block", "_of")), F.col("_block") == F.col("_of")).withColumn(
        "_next", F.coalesce("_next", "_after"))
    return led.select("doc_id", *names, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in names])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, the sketches of the text and the edited text, and their likeness."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    led = with_next(rows, {"kept": lambda text: sketch(word_hashes(text))})
    edited = F.expr("concat(left(text, length(text) - cast(floor(length(text) / 4) as int)), "
                    "left(next_text, cast(floor(length(text) / 4) as int)))")
    made = led.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"),
                      "kept", "next_kept")
    made = made.select("*", sketch(word_hashes(F.col("edited"))).alias("edited_kept"))
    return made.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("kept")).alias("fingerprint"), as_text(F.col("edited_kept")).alias("edited_fingerprint"),
        containment(F.col("kept"), F.col("edited_kept")).alias("near_edited"),
        containment(F.col("kept"), F.col("next_kept")).alias("near_next"))
