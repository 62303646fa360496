"""Mixing sources to target weights with hash-threshold histograms.

Every source gets a target, its share by weight of all words, at most `cap` times its own words; what
a cap cuts off goes to the other sources by weight until none is above its cap.

A document is taken floor(target / source size) times as a whole, and once more if its hash lies below
its source's threshold.  The threshold is found without sorting: words are summed by source and hash
bucket (BITS bits of the hash), the bucket in which the sum passes the need is split by the next BITS
bits, and so on until one hash is left.  Only the boundary bucket's rows are read again.  The rows at
that hash share what is still needed in proportion, so a source misses its target by rounding alone.

The hash is made of the id, so that reruns agree.  Histograms are combined before they are shuffled: a
source with most rows costs 2^BITS sums a task.  Sources are numbered by range partitions, not in one
task, and their table is broadcast only if it is counted and small.

Defined cases: null text has size 0 and is taken 0 words; a null source is a source of its own, the last
one; rows without id or with the same id have the same hash and share alike; no rows, no result rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specengine.llm.common import WORD, fresh, small_or_shuffled, stored
from specengine.operators.skew import with_row_index

CAP = 3
WEIGHTS = (1, 2, 3)
BITS, HASH_BITS = 12, 60


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def place(doc_id: Column) -> Column:
    """The first 60 bits of the id's md5."""
    key = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(key, 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sized: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) of rows (source, size)."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = with_row_index(sizes, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.lit(list(weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    sources = stored(ranked.select("source", "source_size", weight.alias("weight")), "sources")
    own = F.col("source_size") * cap
    total, all_weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    rest, left = total or 0, all_weights or 0
    while left:  # each round caps at least one more source
        over = own.cast("decimal(30,0)") * F.lit(left).cast("decimal(8,0)") <= (
            F.col("weight").cast("decimal(8,0)") * F.lit(rest).cast("decimal(30,0)"))
        capped, their = sources.filter(over).agg(
            F.coalesce(F.sum(own), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if all_weights - their == left:
            break
        rest, left = total - capped, all_weights - their
    share = F.col("weight") * F.lit(rest).cast("long") / F.lit(left).cast("long") if left else own.cast("double")
    return sources.select("source", "source_size", F.least(own.cast("double"), share).alias("target"))


def plan(sized: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: target, whole repeats, the threshold hash, what is needed at it and what lies there.

    sized: (source, size, place), stored.
    """
    known = targets(sized, cap, weights).withColumn(
        "repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(
            F.lit(0)).cast("long")).withColumn(
        "need", F.round(F.col("target") - F.col("repeats") * F.col("source_size")).cast("long"))
    known = stored(known, "targets")
    edge = known.filter("need > 0").select("source", "need", F.lit(0).cast("long").alias("prefix"))
    for shift in range(HASH_BITS - BITS, -1, -BITS):
        inside = edge.select(F.col("source").alias("of"), "prefix", "need")
        rows = sized.join(small_or_shuffled(inside), F.col("source").eqNullSafe(F.col("of"))
                          & (F.shiftright("place", shift + BITS) == F.col("prefix")))
        sums = rows.groupBy("source", "need", F.shiftright("place", shift).alias("bucket")).agg(
            F.sum("size").alias("here"))
        upto = W.partitionBy("source").orderBy("bucket")  # at most 2^BITS rows
        found = sums.withColumn("sum", F.sum("here").over(upto)).filter(
            (F.col("sum") - F.col("here") < F.col("need")) & (F.col("need") <= F.col("sum")))
        edge = stored(found.select("source", (F.col("need") - F.col("sum") + F.col("here")).alias("need"),
                                   F.col("bucket").alias("prefix"), "here"), "edge")
    at = edge.select(F.col("source").alias("of"), F.col("prefix").alias("threshold"),
                     F.col("need").alias("left"), F.col("here").alias("there"))
    return stored(known.join(at, F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "need"), "plan")


def taken(docs: DataFrame, planned: DataFrame, source: str, size: str, hashed: str) -> DataFrame:
    """docs with source_size, target and taken (words, repeats counted)."""
    c = fresh(docs, "of_", "repeats_", "threshold_", "left_", "there_")
    side = planned.select(
        F.col("source").alias(c["of_"]), "source_size", "target", F.col("repeats").alias(c["repeats_"]),
        F.col("threshold").alias(c["threshold_"]), F.col("left").alias(c["left_"]), F.col("there").alias(c["there_"]))
    joined = docs.join(small_or_shuffled(side), F.col(source).eqNullSafe(F.col(c["of_"])))
    n, at = F.col(size), F.col(c["threshold_"])
    more = F.when(F.col(hashed) < at, n).when(
        F.col(hashed) == at, F.floor(F.col(c["left_"]).cast("decimal(19,0)") * n / F.col(c["there_"])).cast("long")
    ).otherwise(F.lit(0).cast("long"))
    return joined.withColumn("taken", n * F.col(c["repeats_"]) + more).drop(*c.values())


def sizes(docs: DataFrame) -> DataFrame:
    return stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"),
                              place(F.col("doc_id")).alias("place")), "sizes")


def mix(docs: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every document."""
    sized = sizes(docs)
    return taken(sized, plan(sized, cap, weights), "source", "size", "place").drop("place")


def mixed_documents(docs: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself, with the columns of docs: a row per repeat; the document at a source's threshold is
    cut after the words that are needed, joined by blanks."""
    c = fresh(docs, "size_", "place_", "copy_", "taken", "source_size", "target")
    if {c[x] for x in ("taken", "source_size", "target")} != {"taken", "source_size", "target"}:
        raise ValueError("documents must not have columns taken, source_size or target")
    sized = docs.withColumns({c["size_"]: n_words(F.col("text")), c["place_"]: place(F.col("doc_id"))})
    chosen = taken(sized, plan(sizes(docs), cap, weights), "source", c["size_"], c["place_"])
    size, whole = F.col(c["size_"]), F.floor(F.col("taken") / F.col(c["size_"]))
    rest = F.col("taken") - whole * size
    rows = chosen.filter("taken > 0").withColumn(
        c["copy_"], F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / size).cast("int"))))
    cut = (F.col(c["copy_"]) > whole) & (rest > 0)
    text = F.when(cut, F.concat_ws(" ", F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), F.lit(1),
                                                rest.cast("int")))).otherwise(F.col("text"))
    out = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(
            docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


MIX_SQL = r"""WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS place
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS s,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, (sum(s) OVER () - coalesce(sum(3 * s) OVER (ORDER BY s / w, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rem,
         (sum(w) OVER (ORDER BY s / w, source NULLS LAST
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS left_w,
         row_number() OVER (ORDER BY s / w, source NULLS LAST) AS k
  FROM src),
cut AS (SELECT rem, left_w FROM ordered WHERE w * rem <= 3 * s * left_w ORDER BY k LIMIT 1),
goals AS (
  SELECT source, s, least((3 * s)::DOUBLE, (w * cut.rem) / cut.left_w) AS target FROM src, cut),
needs AS (
  SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END::BIGINT AS repeats,
         round(target - CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END::BIGINT * s)::BIGINT AS need
  FROM goals),
sums AS (
  SELECT d.*, n.s, n.target, n.repeats, n.need,
         sum(size) OVER (PARTITION BY d.source ORDER BY place)::BIGINT AS upto,
         sum(size) OVER (PARTITION BY d.source, place)::BIGINT AS here
  FROM sized d JOIN needs n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, source, size, s AS source_size, target,
       (size * repeats + CASE WHEN upto <= need THEN size
                              WHEN upto - here < need THEN floor((need - upto + here) * size / here)
                              ELSE 0 END)::BIGINT AS taken
FROM sums"""
