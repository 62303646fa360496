"""Toxicity from class-conditional Kneser-Ney models over words.

The class is the history, the word what follows it.  c(class, w) is the number of labelled documents
of the class that hold w, discounted as in modified Kneser-Ney.  What the discounts free goes to the
word's stem, its first STEM bytes, which is modelled in the same way: p(stem | class) times an equal
share of the stem's known words.  What the stems' discounts free goes to one distribution that both
classes share, the continuation counts: the number of classes a stem was seen in.  A rare word thus
says what its stem says, a rare stem next to nothing, one that only toxic documents use much.

A document gets two length-normalised log-likelihood ratios (toxic against ordinary): the mean over
all its words, and the best mean over WINDOW successive words, since a few insults make a long text
toxic.  A logistic curve, fitted on a bounded sample of labelled documents that the counts don't use
(CALIBRATION_ROWS of them at most), turns the two into a score.

The word table grows with the labelled text.  It is cut by word hash into shards of about SHARD_ROWS
rows, collected and broadcast one at a time.

Defined cases: null text counts as empty; a text without words has ratios 0 and the score of that.
Label ids are taken once, toxic if any of their rows says so; null labels and null ids aren't used.
Without labels of both classes the score is the share of toxic labels (0.0 if there are none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from specengine.llm.common import (
    FEW_BYTES, U, add_columns, chunks, mix, small_or_shuffled, span_hashes, spans, stored, utf8,
)
from specengine.llm.quality_lm import discounts

WINDOW = 4
STEM = 5
CLASSES = ("toxic", "other")
SHARD_ROWS = 4_000_000
CALIBRATION_ROWS = 20_000
#: One labelled document in CALIBRATE calibrates, the others are counted.
CALIBRATE = 4
HELD_WORDS = 1_000_000
LIMIT = 0.7

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(hash, stem's hash, row) of the words of a text column in order, without case; number of rows."""
    data, at = utf8(pc.utf8_lower(column))
    start, end, row = spans(_LETTER[data], at)
    stem = mix(span_hashes(data, start, np.minimum(end, start + STEM)) + U(STEM))
    return span_hashes(data, start, end), stem, row, len(column)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = np.zeros((0, 4), np.int64)  # hash, stem's hash (0: it is a stem), toxic, other

    for batch in chunks(batches, most=FEW_BYTES):
        word, stem, row, _ = _words(batch.column(0))
        if len(word) == 0:
            continue
        label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for key, parent in ((word, stem), (stem, np.zeros_like(stem))):
            order = np.argsort(key, kind="stable")  # rows stay in order within a word
            k, r = key[order], row[order]
            order = order[np.concatenate(([True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])))]
            toxic = label[row[order]]
            words = np.concatenate((words, np.c_[
                key[order].view(np.int64), parent[order].view(np.int64), toxic, 1 - toxic]))
        words = words[np.argsort(words[:, 0], kind="stable")]
        first = np.flatnonzero(np.concatenate(([True], words[1:, 0] != words[:-1, 0])))
        words = np.c_[words[first, :2], np.add.reduceat(words[:, 2:], first)]
        if len(words) > HELD_WORDS:
            yield _rows(words)
            words = words[:0]
    if len(words):
        yield _rows(words)


def _rows(words: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(words[:, i])) for i in range(4)],
                                      ["word", "stem", "toxic", "other"])


def word_counts(labelled: DataFrame) -> DataFrame:
    """(word, stem, toxic, other): documents of either class that hold a word, from (text, toxic 0/1).
    Stems are rows of their own, with 0 for stem."""
    return labelled.mapInArrow(_count, "word long, stem long, toxic long, other long").groupBy("word").agg(
        F.max("stem").alias("stem"), F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _kept(counts: DataFrame) -> tuple[dict[str, Column], dict[str, float]] | None:
    """By class: a row's discounted share of its class, and what all discounts leave; None without both classes."""
    sums = counts.agg(F.sum("toxic"), F.sum("other")).first()
    if not sums[0] or not sums[1]:
        return None
    own, left = {}, {}
    for name, total in zip(CLASSES, sums):
        n, d = F.col(name), discounts(counts.select(F.col(name).alias("n")).filter("n > 0"))
        cut = F.when(n >= 3, d[2]).when(n == 2, d[1]).when(n == 1, d[0]).otherwise(0.0)
        left[name] = counts.agg(F.sum(cut)).first()[0] / total
        own[name] = (n - cut) / F.lit(float(total))
    return own, left


def ratios(counts: DataFrame) -> tuple[DataFrame, float]:
    """((word, ratio): log p(w | toxic) - log p(w | ordinary), for a stem that of its unseen words;
    the ratio of words with an unseen stem)."""
    stems, words = counts.filter("stem = 0").drop("stem"), counts.filter("stem <> 0")
    of_stems, of_words = _kept(stems), _kept(words)
    if of_stems is None or of_words is None:
        return counts.select("word", F.lit(0.0).alias("ratio")).limit(0), 0.0
    classes = sum((F.col(c) > 0).cast("long") for c in CLASSES)
    total = stems.agg(F.sum(classes)).first()[0] + 1.0
    stems = stems.select(F.col("word").alias("stem"), *[
        (of_stems[0][c] + F.lit(of_stems[1][c]) * classes / F.lit(total)).alias(f"p_{c}") for c in CLASSES])
    sizes = words.groupBy("stem").agg(F.count(F.lit(1)).alias("known"))
    stems = stems.join(sizes, "stem")
    p = {c: of_words[0][c] + F.lit(of_words[1][c]) * F.col(f"p_{c}") / (F.col("known") + 1) for c in CLASSES}
    free = float(np.log(of_words[1]["toxic"] / of_words[1]["other"]))
    table = words.join(stems, "stem").select("word", F.log(p["toxic"] / p["other"]).alias("ratio")).union(
        stems.select("stem", F.log(F.col("p_toxic") / F.col("p_other")) + F.lit(free)))
    return table, free + float(np.log(of_stems[1]["toxic"] / of_stems[1]["other"]))


@dataclass
class Model:
    unseen: float
    parts: int
    shards: list[Broadcast] = field(default_factory=list)
    #: constant, mean ratio, window ratio
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    prior: float | None = None

    def ratio(self, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
        out, found = self._find(word)
        rest = np.flatnonzero(~found)
        value, found = self._find(stem[rest])
        out[rest] = np.where(found, value, self.unseen)
        return out

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, found = np.zeros(len(key)), np.zeros(len(key), bool)
        shard = key.view(np.int64) % self.parts
        for i, held in enumerate(self.shards):
            have, value = held.value
            mine = np.flatnonzero(shard == i) if self.parts > 1 else slice(None)
            if len(have):
                k = key[mine]
                place = np.minimum(np.searchsorted(have, k), len(have) - 1)
                out[mine], found[mine] = value[place], have[place] == k
        return out, found

    def features(self, column: pa.Array) -> np.ndarray:
        """Rows of (mean ratio, best window)."""
        word, stem, row, rows = _words(column)
        out = np.zeros((rows, 2))
        if len(word) == 0:
            return out
        sums = np.concatenate(([0.0], np.cumsum(self.ratio(word, stem))))
        n = np.bincount(row, minlength=rows)
        end = np.cumsum(n)
        out[:, 0] = (sums[end] - sums[end - n]) / np.maximum(n, 1)
        place = np.arange(len(word)) - (end - n)[row]
        begin = np.flatnonzero((place == 0) | (place + WINDOW <= n[row]))
        window = (sums[np.minimum(begin + WINDOW, end[row[begin]])] - sums[begin]) / WINDOW
        best = np.full(rows, -np.inf)
        first = np.flatnonzero(np.concatenate(([True], np.diff(row[begin]) > 0)))
        best[row[begin][first]] = np.maximum.reduceat(window, first)
        out[:, 1] = np.where(n > 0, best, 0.0)
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(features), self.prior)
        a, b, c = self.weights
        return 1 / (1 + np.exp(-np.clip(a + features @ np.array([b, c]), -500, 500)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    middle, width = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - middle) / width]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w += np.linalg.solve((z.T * (p * (1 - p))) @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
    slope = w[1:] / width
    return float(w[0] - slope @ middle), float(slope[0]), float(slope[1])


def is_held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text modulo 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, shard_rows: int = SHARD_ROWS) -> Model:
    """Learn from `labels.toxic` of the rows that aren't held out."""
    spark = docs.sparkSession
    known = labels.filter(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("toxic").cast("long").alias("toxic")).filter("toxic IN (0, 1)").withColumn(
        "place", F.xxhash64("doc_id"))
    counted = known.filter(F.pmod("place", F.lit(CALIBRATE)) != 0).drop("place")
    # A bounded sample: the smallest hashes.
    sample = known.filter(F.pmod("place", F.lit(CALIBRATE)) == 0).orderBy("place", "doc_id").limit(
        CALIBRATION_ROWS).drop("place")
    texts = docs.select("doc_id", "text")
    counts = stored(word_counts(texts.join(small_or_shuffled(counted), "doc_id").select("text", "toxic")), "words")
    table, unseen = ratios(counts)
    n = counts.count()
    model = Model(unseen, max(1, -(-n // shard_rows)))
    for i in range(model.parts):
        rows = table.filter(F.pmod("word", F.lit(model.parts)) == i).toArrow()
        word = rows.column(0).to_numpy().view(U)
        order = np.argsort(word)
        model.shards.append(spark.sparkContext.broadcast(
            (word[order], rows.column(1).to_numpy()[order].astype(np.float32))))
    judged = with_score(texts.join(small_or_shuffled(sample), "doc_id"), model, keep_text=False).select(
        "toxic", "mean_ratio", "window_ratio").toArrow().to_pandas().to_numpy(np.float64)
    y = judged[:, 0] if len(judged) else np.zeros(0)
    if 0 < y.sum() < len(y):
        model.weights = _logistic(judged[:, 1:], y)
    else:
        share = known.agg(F.avg("toxic")).first()[0]
        model.prior = float(share or 0.0)
    return model


def with_score(docs: DataFrame, model: Model, keep_text: bool = True) -> DataFrame:
    """docs with mean_ratio, window_ratio and score."""
    schema = StructType([f for f in docs.schema.fields if keep_text or f.name != "text"])
    for name in ("mean_ratio", "window_ratio", "score"):
        schema = schema.add(name, DoubleType())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=FEW_BYTES):
            f = model.features(batch.column(batch.schema.get_field_index("text")))
            yield add_columns(batch, () if keep_text else ("text",), mean_ratio=f[:, 0], window_ratio=f[:, 1],
                              score=model.score(f))

    return docs.mapInArrow(judge, schema)


def keep_ordinary(docs: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """The documents below the limit, with their own columns."""
    model = fit(docs, labels)
    own = docs.schema
    safe = docs.toDF(*[f"c{i}" if f.name != "text" else "text" for i, f in enumerate(own.fields)])
    kept = with_score(safe, model).filter(F.col("score") < limit).select(*safe.columns)
    return kept.toDF(*own.names)
