"""Nearest neighbours by learned partitions.

Fit, on a bounded sample (FIT_ROWS vectors): the neighbour graph of the sample
is made on Spark, cut into parts of equal size by recursive bisection with
swaps that lower the number of cut edges, and a small softmax classifier learns
from a vector the shares of its neighbours' parts.  The index holds every row:
each lies in the part that the classifier finds most probable.  A query visits
parts in falling probability until they add up to a mass that was calibrated on
sample rows kept out of training, and always enough of them to hold all the
neighbours asked for.  All rows of the visited parts are compared in double
precision.

Number of parts: a power of two near a quarter of the root of the number of
rows, at most MAX_PARTS.  A part of more than BLOCK_ROWS rows, or with more than
BLOCK_QUERIES queries, is cut into blocks on both sides; every visiting query
meets every row of the part once, whatever its share of the data.  A query
takes one list of at most `k` neighbours out of each block, never pairs.  Equal
vectors within a block are multiplied once.

Defined cases: vectors null, empty, zero, with null or non-finite entries, or
not of the most common length take no part, nor do rows without id.  Repeated
rows count once; of different vectors with one id the smallest counts.  Ties go
to the smaller id.  With fewer than k candidates all come; an empty table, or
one vector, gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specengine.llm.common import stored
from specengine.llm.vectors import matrix, usable

#: Neighbours returned.
K = 20
#: Sample rows for the graph and the classifier; a quarter of them calibrates.
FIT_ROWS = 8_192
#: Neighbours of a row in the sample's graph.
GRAPH_K = 10
MAX_PARTS = 256
#: Recall on the calibration rows that fixes how much probability a query visits.
TARGET = 0.97
BLOCK_ROWS, BLOCK_QUERIES = 32_768, 8_192
EPOCHS, RATE, BATCH = 40, 0.05, 256
#: Queries compared at a time within a block.
SLICE = 256


@dataclass
class Router:
    """The classifier and the probability mass that a query visits.

    Its inputs are a vector's direction, the logarithm of its length against
    the middle length (long vectors are near to many), and whether it asks.
    """

    middle: float
    weights: np.ndarray
    bias: np.ndarray
    mass: float

    def features(self, x: np.ndarray, asks: bool) -> np.ndarray:
        unit, length = _unit(x)
        far = np.clip(np.log(np.maximum(length / self.middle, 1e-300)), -2, 2)
        return np.column_stack((unit, np.zeros(len(unit)) if asks else far, np.full(len(unit), float(asks))))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(self.features(x, True) @ self.weights + self.bias)

    def parts(self, x: np.ndarray) -> np.ndarray:
        return (self.features(x, False) @ self.weights + self.bias).argmax(1)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and lengths of vectors that aren't zero, without overflow."""
    x = np.asarray(x, float)
    scale = np.abs(x).max(1)
    x = x / scale[:, None]
    length = np.linalg.norm(x, axis=1)
    return x / length[:, None], np.minimum(length * scale, 1e300)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of each row, falling."""
    at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(scores, at, 1), axis=1, kind="stable"), 1)


def neighbour_graph(sample: DataFrame, x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest sample rows of every sample row (its own excluded), nearest first, found by tasks over the sample."""
    shared = sample.sparkSession.sparkContext.broadcast(x)  # FIT_ROWS rows at most

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            for first in range(0, len(at), SLICE):
                own = at[first:first + SLICE]
                scores = shared.value[own] @ shared.value.T
                scores[np.arange(len(own)), own] = -np.inf
                found = _top(scores, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array(found.tolist(), pa.list_(pa.int64()))], ["at", "near"])

    spark = sample.sparkSession
    rows = spark.range(0, len(x), 1, max(1, min(len(x) // SLICE, spark.sparkContext.defaultParallelism)))
    found = rows.mapInArrow(near, "at long, near array<long>").toArrow().sort_by("at")
    shared.destroy()
    return matrix(found.column("near"))


def balanced_parts(graph: np.ndarray, x: np.ndarray, parts: int) -> np.ndarray:
    """Part of each row: halves of halves of the graph, each cut made smaller by swaps."""
    n, k = graph.shape
    a, b = np.repeat(np.arange(n), k), graph.ravel()
    edges = np.concatenate((np.stack((a, b), 1), np.stack((b, a), 1)))
    part = np.zeros(n, int)
    count = 1
    while count < parts:
        inner = edges[part[edges[:, 0]] == part[edges[:, 1]]]
        side = _halves(x, part, count)
        for _ in range(24):
            same = side[inner[:, 0]] == side[inner[:, 1]]
            gain = np.bincount(inner[:, 0], np.where(same, -1.0, 1.0), n)
            swapped = 0
            for p in range(count):
                left = np.flatnonzero((part == p) & (side == 0))
                right = np.flatnonzero((part == p) & (side == 1))
                left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
                m = min(len(left), len(right))
                good = int((gain[left[:m]] + gain[right[:m]] > 0).sum())
                good = (good + 1) // 2  # neighbours that move at once would undo each other's gain
                side[left[:good]], side[right[:good]] = 1, 0
                swapped += good
            if not swapped:
                break
        part, count = 2 * part + side, 2 * count
    return part


def _halves(x: np.ndarray, part: np.ndarray, count: int) -> np.ndarray:
    """Halves of every part at the median of its direction of largest spread."""
    side = np.zeros(len(x), int)
    for p in range(count):
        own = np.flatnonzero(part == p)
        if len(own) > 1:
            c = x[own] - x[own].mean(0)
            onto = c @ np.linalg.eigh(c.T @ c)[1][:, -1]
            side[own[np.argsort(onto, kind="stable")[len(own) // 2:]]] = 1
    return side


def _train(x: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression on the neighbours' shares of parts, by Adam."""
    random = np.random.default_rng(11)
    w = [np.zeros((x.shape[1], goal.shape[1])), np.zeros(goal.shape[1])]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    step = 0
    for epoch in range(EPOCHS):
        order = random.permutation(len(x))
        for first in range(0, len(x), BATCH):
            own = order[first:first + BATCH]
            off = (_softmax(x[own] @ w[0] + w[1]) - goal[own]) / len(own)
            step += 1
            for i, g in enumerate((x[own].T @ off + 1e-5 * w[0], off.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                rate = RATE * (1 - epoch / EPOCHS)
                w[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return w[0], w[1]


def fit(rows: DataFrame, total: int, k: int = K, max_parts: int = MAX_PARTS, fit_rows: int = FIT_ROWS) -> Router:
    """Learn the parts from the sample rows with the smallest hashes of (id, vector)."""
    sample = rows.orderBy(F.xxhash64("id", "vector"), "id").limit(fit_rows)
    x = matrix(sample.select("vector").toArrow().column(0)).astype(float)
    unit, length = _unit(x)
    middle = float(np.median(length))
    parts = 1 << max(0, round(math.log2(max(1.0, math.sqrt(total) / 4))))
    parts = min(parts, max_parts, 1 << max(0, int(math.log2(max(1, len(x) // 32)))))
    if parts == 1:
        return Router(middle, np.zeros((x.shape[1] + 2, 1)), np.zeros(1), 1.0)
    near = neighbour_graph(sample, unit * (length / length.max())[:, None], min(max(k, GRAPH_K), len(x) - 1))
    graph = near[:, :GRAPH_K]
    part = balanced_parts(graph, x, parts)
    lies, asks = np.zeros((len(x), parts)), np.zeros((len(x), parts))
    lies[np.arange(len(x)), part] = 1.0
    np.add.at(asks, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1.0 / graph.shape[1])
    learn, held = np.flatnonzero(np.arange(len(x)) % 4 != 0), np.arange(0, len(x), 4)
    router = Router(middle, np.zeros(0), np.zeros(0), 1.0)
    router.weights, router.bias = _train(
        np.concatenate((router.features(x[learn], False), router.features(x[learn], True))),
        np.concatenate((lies[learn], asks[learn])))
    router.mass = _calibrated(router, x, near, held)
    return router


def _calibrated(router: Router, x: np.ndarray, near: np.ndarray, held: np.ndarray) -> float:
    """The least mass at which the share TARGET of the held-out rows' neighbours lies in visited parts."""
    own = router.probabilities(x[held])
    order = np.argsort(-own, axis=1, kind="stable")
    ranked = np.take_along_axis(own, order, 1)
    before = np.empty_like(own)
    np.put_along_axis(before, order, np.cumsum(ranked, 1) - ranked, 1)
    needed = np.take_along_axis(before, router.parts(x)[near[held]], 1)
    return float(min(1.0, np.quantile(needed, TARGET, method="higher") + 1e-9))


def visited(router: Router, sizes: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its parts): in falling probability up to the mass, and on until they hold k rows besides the row itself."""
    chances = router.probabilities(x)
    order = np.argsort(-chances, axis=1, kind="stable")
    ranked = np.take_along_axis(chances, order, 1)
    before = np.cumsum(ranked, 1) - ranked
    held = np.cumsum(sizes[order], 1) - sizes[order]
    visit = (before < router.mass) | (held < k + 1)
    for i, (own, go) in enumerate(zip(order, visit)):
        yield i, own[go & (sizes[own] > 0)]


def _compare(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def compare(queries: pa.Table, rows: pa.Table) -> pa.Table:
        """The k best rows of a block for each of a block's queries."""
        ids, x = rows.column("id").to_numpy(), matrix(rows.column("vector")).astype(float)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        _, first, same = np.unique(x, axis=0, return_index=True, return_inverse=True)
        same = same.ravel()
        asked, q = queries.column("query_id").to_numpy(), matrix(queries.column("vector")).astype(float)
        out_ids, out_scores = [], []
        for begin in range(0, len(asked), SLICE):
            own = q[begin:begin + SLICE]
            near = (own @ x[first].T)[:, same]
            near[asked[begin:begin + SLICE, None] == ids] = -np.inf
            for i in range(len(own)):
                m = min(k, len(ids))
                least = np.partition(near[i], len(ids) - m)[len(ids) - m]
                at = np.flatnonzero((near[i] >= least - 1e-9 * max(1.0, abs(least))) & (near[i] > -np.inf))
                # The products' sums are rounded once, so equal nearness compares equal in every block.
                exact = (own[i].astype(np.longdouble) * x[at]).sum(1).astype(float)
                best = np.lexsort((ids[at], -exact))[:k]
                out_ids.append(ids[at][best])
                out_scores.append(exact[best])
        return pa.table({
            "query_id": pa.array(asked),
            "found": pa.array([[{"vec_id": int(a), "score": float(s)} for a, s in zip(i, s)]
                               for i, s in zip(out_ids, out_scores)],
                              pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())])))})
    return compare


def search(df: DataFrame, is_query: Column, id_column: str = "vec_id", column: str = "embedding",
           k: int = K, max_parts: int = MAX_PARTS, fit_rows: int = FIT_ROWS,
           block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of every row whose id meets `is_query`, a column over "id"."""
    spark = df.sparkSession
    every = usable(df, id_column, column).filter(
        F.col("id").isNotNull() & F.exists("vector", lambda c: c != 0)).groupBy(F.col("id").cast("long").alias("id")).agg(
        F.min("vector").alias("vector"))
    every = stored(every, "learned-rows")
    total = every.count()
    result = "query_id long, rank int, vec_id long, score double"
    if total < 2:
        return spark.createDataFrame([], result)
    router = fit(every, total, k, max_parts, fit_rows)
    n_parts = len(router.bias)
    kind = every.schema["vector"].dataType

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(router.parts(matrix(batch.column(1))), pa.int32()), *batch.columns], ["part", "id", "vector"])

    index = stored(every.mapInArrow(placed, T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("vector", kind)])),
        "learned-index")
    sizes = np.zeros(n_parts, int)
    for row in index.groupBy("part").count().collect():  # MAX_PARTS rows
        sizes[row.part] = row["count"]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts, at = [], []
                for i, own in visited(router, sizes, matrix(batch.column(1)), k):
                    parts.append(own)
                    at.append(np.full(len(own), i))
                at = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(parts), pa.int32()), batch.column(0).take(at), batch.column(1).take(at)],
                    ["part", "query_id", "vector"])

    asks = index.filter(is_query).select("id", "vector").mapInArrow(routed, T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("query_id", T.LongType()), T.StructField("vector", kind)]))
    asked = np.zeros(n_parts, int)
    for row in asks.groupBy("part").count().collect():  # MAX_PARTS rows
        asked[row.part] = row["count"]
    # Blocks of both sides by part, MAX_PARTS numbers each.
    cut_rows = F.array(*[F.lit(max(1, math.ceil(s / block_rows))) for s in sizes.tolist()])
    cut_asks = F.array(*[F.lit(max(1, math.ceil(s / block_queries))) for s in asked.tolist()])

    def blocks(frame: DataFrame, own: Column, own_name: str, other: Column, other_name: str, key: str) -> DataFrame:
        return frame.withColumn(own_name, F.pmod(F.xxhash64(F.lit(5), key), F.get(own, F.col("part")).cast("long"))).withColumn(
            other_name, F.explode(F.sequence(F.lit(0).cast("long"), F.get(other, F.col("part")).cast("long") - 1)))

    left = blocks(asks, cut_asks, "q", cut_rows, "r", "query_id")
    right = blocks(index, cut_rows, "r", cut_asks, "q", "id")
    keys = ["part", "q", "r"]
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _compare(k), "query_id long, found array<struct<vec_id:long,score:double>>")
    merged = lists.groupBy("query_id").agg(F.flatten(F.collect_list("found")).alias("found")).select(
        "query_id", F.slice(F.array_sort(F.transform("found", lambda x: F.struct(
            (-x.score).alias("far"), x.vec_id.alias("vec_id"), x.score.alias("score")))), 1, k).alias("found"))
    return merged.select("query_id", F.posexplode("found").alias("i", "f")).select(
        "query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"),
        F.col("f.score").alias("score"))
