"""Quality classifier: interpolated modified Kneser-Ney model over the bytes of trusted texts.

1. Byte 5-grams of all trusted texts are counted: each task combines its own, a shuffle adds them.
2. Lower orders count the distinct left neighbours of a gram; discounts come from counts of counts,
   and each order's probabilities are a join of its counts, its contexts and the order below.
3. The finished model is cut into shards by the two bytes before the predicted one, so that one shard
   answers every order for a position.  A shard has at most SHARD_ROWS rows (or those of one pair of
   bytes, 256^3), and it alone is collected and broadcast at a time; orders 1 and 2 are a 256 x 256
   table.  The number of shards grows with what the trusted text holds, their size doesn't.
4. A task reads its documents once and looks every position up in the shard it belongs to.

Documents are judged by bits per byte, drawn towards the language's median as if PRIOR_BYTES more
bytes of it had been read, so that a few words alone don't condemn a text.  One trusted document in
HELD_OUT is kept from the counts; the quantiles of these give each language's limit.

Defined cases: a null or blank text has no evidence: bits null, kept false.  A language without
MIN_HELD_OUT held-out trusted documents (null too) takes the limit over all languages; without any
trusted document at all every text that isn't blank is kept.  Repeated rows are judged alike, each
label id counts once, and labels that disagree don't make a document trusted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specengine.llm.common import FEW_BYTES, U, add_columns, chunks, fresh, small_or_shuffled, stored, utf8, words

ORDER = 5
SHARD_ROWS = 4_000_000
SYMBOLS = 257
END = 3
HELD_OUT = 10
MIN_HELD_OUT = 50
PRIOR_BYTES = 200
#: A document may exceed the median by SPREADS times the way from it to the QUANTILE.
QUANTILE, SPREADS = 0.95, 4.0
#: Grams that a task holds before it hands them on.
HELD_GRAMS = 2_000_000


def _grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(5-gram that ends at each byte and at the end of each text, first position of each text)."""
    rows = len(at) - 1
    first = at[:-1] + np.arange(rows)
    flat = np.zeros(len(data) + ORDER * rows + ORDER, U)
    for i in range(rows):
        to = at[i] + ORDER * i + ORDER - 1
        flat[to:to + at[i + 1] - at[i]] = data[at[i]:at[i + 1]]
        flat[to + at[i + 1] - at[i]] = END
    two = (flat[:-1] << U(8)) | flat[1:]
    four = (two[:-2] << U(16)) | two[2:]
    five = (four[:-1] << U(8)) | flat[4:]
    # A text of n bytes has n + 1 grams; the ORDER - 1 that would straddle two texts are left out.
    keep = np.ones(len(five), bool)
    for k in range(ORDER - 1):
        keep[at[1:] + ORDER * np.arange(rows) + 1 + k] = False
    keep[at[-1] + ORDER * (rows - 1) + 1:] = False
    return five[keep], first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams, counts = np.zeros(0, U), np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int64)), pa.array(counts)], ["gram", "n"])

    for batch in chunks(batches, most=FEW_BYTES):
        g = np.sort(_grams(*utf8(batch.column(0)))[0])
        new = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        both = np.concatenate((grams, g[new]))
        n = np.concatenate((counts, np.diff(np.append(new, len(g)))))
        grams, place = np.unique(both, return_inverse=True)
        counts = np.bincount(place, n, len(grams)).astype(np.int64)
        if len(grams) > HELD_GRAMS:
            yield out()
            grams, counts = np.zeros(0, U), np.zeros(0, np.int64)
    if len(grams):
        yield out()


def gram_counts(texts: DataFrame) -> DataFrame:
    """(gram, n): byte 5-grams of the one text column, packed into a long."""
    return texts.mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2, and 3 or more."""
    row = counts.agg(*[F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in range(1, 5)]).first()
    n = [max(1, row[i] or 0) for i in range(4)]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(i - 0.05, max(0.05, i - (i + 1) * y * n[i] / n[i - 1])) for i in (1, 2, 3)]


def _discount(n, d: list[float]):
    return F.when(n >= 3, d[2]).when(n == 2, d[1]).otherwise(d[0])


def probabilities(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """The model, (kind, key, value): kind n is log p of an n-gram, kind 10 + n is the log weight that
    a context of n - 1 bytes leaves to the order below."""
    tables = {order: stored(counts, "grams")}
    for n in range(order - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND((1 << 8 * n) - 1)
        tables[n] = stored(tables[n + 1].groupBy(suffix.alias("gram")).agg(F.count(F.lit(1)).alias("n")), "grams")
    parts, lower = [], None
    for n in range(1, order + 1):
        d = discounts(tables[n])
        cut = _discount(F.col("n"), d)
        rows = tables[n].withColumn("context", F.shiftright("gram", 8))
        contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum(cut).alias("cut")).select(
            "context", "total", (F.col("cut") / F.col("total")).alias("left"))
        below = F.lit(1.0 / SYMBOLS) if lower is None else F.col("p_lower")
        joined = rows.join(contexts, "context")
        if lower is not None:
            joined = joined.join(
                lower.withColumnsRenamed({"gram": "suffix", "p": "p_lower"}),
                F.col("gram").bitwiseAND((1 << 8 * (n - 1)) - 1) == F.col("suffix"))
        lower = joined.select("gram", ((F.col("n") - cut) / F.col("total") + F.col("left") * below).alias("p"))
        lower = stored(lower, "orders")
        parts += [lower.select(F.lit(n).alias("kind"), F.col("gram").alias("key"), F.log("p").alias("value")),
                  contexts.select(F.lit(10 + n), "context", F.log("left"))]
    model = parts[0]
    for part in parts[1:]:
        model = model.union(part)
    return stored(model.select("kind", "key", F.col("value").cast("float")), "model")


def _pair(kind: str = "kind"):
    """The two bytes before the predicted one."""
    return F.when(F.col(kind) > 10, F.col("key")).otherwise(F.shiftright("key", 8)).bitwiseAND(0xFFFF)


@dataclass
class Model:
    """Broadcast shards; `cuts` are the first byte pairs of the shards, `pairs` log p of every 2-gram."""

    cuts: np.ndarray
    pairs: np.ndarray
    shards: list[Broadcast] = field(default_factory=list)

    def log_p(self, grams: np.ndarray) -> np.ndarray:
        out = np.empty(len(grams), np.float32)
        if len(self.shards) == 1:
            return _look_up(self.shards[0].value, self.pairs, grams)
        which = np.searchsorted(self.cuts, (grams >> U(8)) & U(0xFFFF), "right") - 1
        for i in np.unique(which):
            mine = which == i
            out[mine] = _look_up(self.shards[i].value, self.pairs, grams[mine])
        return out


def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    have, values = table
    if len(have) == 0:
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
    place = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    hit = have[place] == keys
    return hit, np.where(hit, values[place], np.float32(0))


def _look_up(shard: dict, pairs: np.ndarray, grams: np.ndarray) -> np.ndarray:
    hit, out = _find(shard[ORDER], grams)
    rest, g = np.flatnonzero(~hit), grams[~hit]
    for n in range(ORDER, 2, -1):
        if len(rest) == 0:
            return out
        if n < ORDER:
            g = g & U((1 << 8 * n) - 1)
            hit, value = _find(shard[n], g)
            out[rest[hit]] += value[hit]
            rest, g = rest[~hit], g[~hit]
        out[rest] += _find(shard[10 + n], g >> U(8))[1]
    out[rest] += pairs[(g & U(0xFFFF)).astype(np.int64)]
    return out


def _dense_pairs(rows: dict[int, dict[int, float]]) -> np.ndarray:
    left = rows.get(11, {}).get(0, 0.0)
    one = np.full(256, left - np.log(SYMBOLS), np.float64)
    for k, v in rows.get(1, {}).items():
        one[k] = v
    weight = np.zeros(256)
    for k, v in rows.get(12, {}).items():
        weight[k] = v
    two = (weight[:, None] + one[None, :]).ravel()
    for k, v in rows.get(2, {}).items():
        two[k] = v
    return two.astype(np.float32)


def broadcast_model(spark: SparkSession, model: DataFrame, shard_rows: int = SHARD_ROWS) -> Model:
    base: dict[int, dict[int, float]] = {}
    for kind, key, value in model.filter(F.col("kind").isin(1, 2, 11, 12)).collect():  # at most 66,000 rows
        base.setdefault(kind, {})[key] = value
    large = model.filter(~F.col("kind").isin(1, 2, 11, 12))
    sizes = sorted(tuple(r) for r in large.groupBy(_pair().alias("pair")).count().collect())  # at most 65,536 rows
    cuts, held = [0], 0
    for pair, n in sizes:
        if held and held + n > shard_rows:
            cuts.append(pair)
            held = 0
        held += n
    out = Model(np.array(cuts, U), _dense_pairs(base))
    for low, high in zip(cuts, [*cuts[1:], 1 << 16]):
        rows = large.filter((_pair() >= low) & (_pair() < high)).toArrow()
        kind, key = rows.column(0).to_numpy(), rows.column(1).to_numpy().astype(U)
        value, shard = rows.column(2).to_numpy(), {}
        for k in (*range(3, ORDER + 1), *range(13, ORDER + 11)):
            mine = np.flatnonzero(kind == k)
            mine = mine[np.argsort(key[mine])]
            shard[k] = (key[mine], value[mine].astype(np.float32))
        out.shards.append(spark.sparkContext.broadcast(shard))
    return out


def with_bits(docs: DataFrame, model: Model, text: str, bits: str, size: str, keep_text: bool = True) -> DataFrame:
    """Add (bits: -log2 p of the whole text, size: predicted symbols); null where the text is null or blank."""
    from pyspark.sql.types import DoubleType, LongType, StructType

    kept = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = StructType(kept).add(bits, DoubleType()).add(size, LongType())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text, FEW_BYTES):
            column = batch.column(batch.schema.get_field_index(text))
            data, at = utf8(column)
            grams, first = _grams(data, at)
            value = np.add.reduceat(model.log_p(grams), first, dtype=np.float64) / -np.log(2)
            blank = np.bincount(words(data, at)[2], minlength=len(at) - 1) == 0  # no word, however long
            yield add_columns(batch, () if keep_text else (text,), **{
                bits: pa.array(value, mask=blank), size: pa.array(np.diff(at) + 1)})

    return docs.mapInArrow(score, schema)


#: Columns of the verdict.
RESULTS = ("perplexity", "bits_per_byte", "bits_limit", "kept")


@dataclass
class Classifier:
    model: Model
    limits: DataFrame


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Train on the texts of documents whose label is quality 1; limits by `lang`."""
    spark = docs.sparkSession
    trusted = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min("quality").alias("quality")).filter("quality = 1").select(
        "doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0).alias("held_out"))
    texts = docs.select("doc_id", "lang", "text").filter(F.length("text") > 0)
    counted = texts.join(small_or_shuffled(trusted.filter("NOT held_out")), "doc_id", "left_semi")
    model = broadcast_model(spark, probabilities(gram_counts(counted.select("text"))))
    held = texts.join(small_or_shuffled(trusted.filter("held_out")), "doc_id", "left_semi")
    rate = stored(with_bits(held.select("lang", "text"), model, "text", "bits", "size", keep_text=False).filter(
        "bits IS NOT NULL"), "held")
    middle = rate.groupBy(F.col("lang").alias("of")).agg(
        F.percentile_approx(F.col("bits") / F.col("size"), 0.5, 10_000).alias("middle"),
        F.count(F.lit(1)).alias("n"))
    overall = rate.agg(F.percentile_approx(F.col("bits") / F.col("size"), 0.5, 10_000)).first()[0]
    drawn = (F.col("bits") + PRIOR_BYTES * F.col("middle")) / (F.col("size") + PRIOR_BYTES)
    upper = rate.join(small_or_shuffled(middle), F.col("lang").eqNullSafe(F.col("of"))).select(
        "lang", "middle", "n", drawn.alias("drawn"))
    by_lang = upper.groupBy("lang").agg(
        F.first("middle").alias("middle"), F.first("n").alias("n"),
        F.percentile_approx("drawn", QUANTILE, 10_000).alias("high"))
    if overall is None:
        limits = by_lang.select("lang", "middle", F.lit(None).cast("double").alias("limit"))
        return Classifier(model, stored(limits, "limits"))
    everything = rate.withColumn("middle", F.lit(overall)).agg(
        F.percentile_approx(drawn, QUANTILE, 10_000)).first()[0]
    known = by_lang.filter((F.col("n") >= MIN_HELD_OUT) & F.col("lang").isNotNull()).select(
        "lang", "middle", (F.col("middle") + SPREADS * (F.col("high") - F.col("middle"))).alias("limit"))
    other = spark.range(1).select(F.lit(None).cast("string").alias("lang"), F.lit(float(overall)).alias("middle"),
                                  F.lit(float(overall + SPREADS * (everything - overall))).alias("limit"))
    return Classifier(model, stored(known.union(other), "limits"))


def classify(docs: DataFrame, classifier: Classifier, keep_text: bool = True) -> DataFrame:
    """docs with perplexity (per byte), bits, its language's limit, and kept.

    A result column whose name docs has already gets an underscore in front (see `fresh`)."""
    c = fresh(docs, "bits_", "size_", "lang_", "middle_", "limit_")
    out = fresh(docs, *RESULTS)
    scored = with_bits(docs, classifier.model, "text", c["bits_"], c["size_"], keep_text)
    limits = classifier.limits.withColumnsRenamed({"lang": c["lang_"], "middle": c["middle_"], "limit": c["limit_"]})
    own = limits.filter(F.col(c["lang_"]).isNotNull())
    other = limits.filter(F.col(c["lang_"]).isNull()).first()
    bits, size = F.col(c["bits_"]), F.col(c["size_"])
    middle = F.coalesce(F.col(c["middle_"]), F.lit(other[1] if other else None).cast("double"))
    limit = F.coalesce(F.col(c["limit_"]), F.lit(other[2] if other else None).cast("double"))
    drawn = (bits + PRIOR_BYTES * middle) / (size + PRIOR_BYTES)
    joined = scored.join(small_or_shuffled(own), scored["lang"] == own[c["lang_"]], "left")
    return joined.withColumns({
        out["perplexity"]: F.pow(F.lit(2.0), bits / size), out["bits_per_byte"]: drawn, out["bits_limit"]: limit,
        out["kept"]: bits.isNotNull() & F.coalesce(drawn <= limit, F.lit(True)),
    }).drop(*c.values())


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with their own columns."""
    kept = fresh(docs, *RESULTS)["kept"]
    return classify(docs, fit(docs, labels)).filter(F.col(kept)).select(*docs.columns)
