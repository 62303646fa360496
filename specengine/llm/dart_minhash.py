"""Near-duplicates by DartMinHash signatures, banded joining and exact verification.

A document is the multiset of its five-word shingles.  Every occurrence number of a shingle is an element
region of weight 1, into which hashed darts fall as a Poisson process over the rank: a dart's rank and
coordinate depend on the element alone.  Of COORDINATES coordinates each keeps the dart of the lowest
rank, so two documents agree on a coordinate with probability equal to their weighted Jaccard
similarity.  Only darts below the rank at which a document expects COORDINATES * (ln COORDINATES + 3)
of them are thrown, which costs its weight plus that number, whatever the weights; a document that
leaves a coordinate empty throws on up to twice the rank.

BANDS bands of ROWS coordinates are the join keys: a pair of similarity 0.8 misses all of them with
probability (1 - 0.8^8)^40 = 0.0006, one of 0.9 never; one of 0.4 meets with 0.026.

1. Equal texts are one node (md5 of the text), so copies cost one row.
2. Bands are counted, and those of one node dropped.  In each band's bucket the node that shares most
   buckets leads: it is the most central text.  Members are paired with their leader, not with each other.
3. Pairs are verified by the exact similarity of their whole texts; components of the links are classes.
4. A bucket whose members are of several classes stays open with all of them.  Its members outside its
   largest class meet every member of another class, in blocks of BLOCK by BLOCK rows or BLOCK_BYTES.  A
   block compares by signatures (one byte a coordinate) first, in the first band that both share, and
   verifies what may be similar enough by the exact similarity of the elements, which are sent once per
   member and block.  It joins classes as it goes and hands on the links that joined two, never pairs, so
   what lies below the similarity leaves no row.  No bucket is capped.  A bucket of n members of which m
   lie outside its largest class costs m * n comparisons of 320 bytes.

What this can miss: the bands' share above, and pairs whose signatures agree DEVIATIONS standard
deviations less than their similarity lets expect (some 1e-9 of those at 0.8).  Every other pair that
shares a bucket is verified, or its texts are of one class without it.

Buckets, leaders and links are counted and joined by key; hot keys are partially aggregated or split by
the adaptive skew join.  Defined cases: null texts and texts without words have no shingles, and each is
a class of its own; texts of fewer than five words are one shingle; rows without id take part, but never
name a class unless no row of it has an id (then the class id is null); repeated rows are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specengine.llm.common import (
    U, chunks, fresh, mix, shingle_hashes, small_or_shuffled, span_hashes, stored, utf8, words,
)
from specengine.operators.cluster import connected_components

SHINGLE = 5
ROWS, BANDS = 8, 40
COORDINATES = ROWS * BANDS
SIMILARITY = 0.8
#: Members of a bucket that are compared with as many others in one block, and the bytes of either.
BLOCK, BLOCK_BYTES = 512, 8_000_000
DEVIATIONS = 6
#: Text and rows that a task signs or compares at a time; a row throws some 2,800 darts, however short it is.
STEP_BYTES, STEP_ROWS = 500_000, 512
_GOLDEN = U(0x9E3779B97F4A7C15)


def weighted_elements(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every shingle occurrence; the second occurrence of a shingle is another element."""
    start, end, row = words(data, at)
    h, of = shingle_hashes(span_hashes(data, start, end), row, len(at) - 1, SHINGLE)
    order = np.argsort(h + mix(of.astype(U)), kind="stable")
    h, of = h[order], of[order]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])))) if len(h) else []
    count = np.diff(np.append(new, len(h)))
    place = np.arange(len(h)) - np.repeat(new, count) if len(h) else np.zeros(0, np.int64)
    return mix(h + place.astype(U) * _GOLDEN), of


def signatures(element: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """(rows, COORDINATES) dart hashes; rows without elements stay 0."""
    weight = np.bincount(row, minlength=rows)
    best = np.full(rows * COORDINATES, np.inf)
    sig = np.zeros(rows * COORDINATES, U)
    reach = np.where(weight > 0, COORDINATES * (np.log(COORDINATES) + 3) / np.maximum(weight, 1), 0.0)
    # Of the cells that still throw: hash, row, rank and number of the last dart.
    cell, of = element, row
    rank, number = np.zeros(len(cell)), np.zeros(len(cell), U)
    paused: list[tuple] = []
    step = 1
    while True:
        while len(cell):
            js = number[:, None] + np.arange(1, step + 1, dtype=U)[None, :]
            dart = mix(cell[:, None] + js * _GOLDEN)
            uniform = ((mix(dart + U(1)) >> U(11)).astype(np.float64) + 0.5) * 2.0 ** -53
            ranks = rank[:, None] - np.cumsum(np.log(uniform), axis=1)
            inside = ranks < reach[of][:, None]
            key = (of[:, None] * COORDINATES + (dart % U(COORDINATES)).astype(np.int64))[inside]
            r, d = ranks[inside], dart[inside]
            np.minimum.at(best, key, r)
            won = best[key] == r
            sig[key[won]] = d[won]
            # Where a rank passed the reach, the cell pauses before that dart.
            go = inside[:, -1]
            last = inside.sum(axis=1)
            rest = ~go
            before = np.where(last > 0, ranks[np.arange(len(cell)), np.maximum(last - 1, 0)], rank)
            paused.append((cell[rest], of[rest], before[rest], (number + last.astype(U))[rest]))
            cell, of, rank, number = cell[go], of[go], ranks[go, -1], number[go] + U(step)
            step = min(step * 2, 64)
        short = np.isinf(best.reshape(rows, COORDINATES)).any(axis=1) & (weight > 0)
        if not short.any():
            return sig.reshape(rows, COORDINATES)
        reach[short] *= 2
        joined = [np.concatenate(x) for x in zip(*paused)]
        on = short[joined[1]]
        cell, of, rank, number = (x[on] for x in joined)
        paused, step = [], 1


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(rows, BANDS) join keys, which carry their band's number."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), parts.shape[:2])
    for i in range(ROWS):
        out = mix(out * _GOLDEN + parts[:, :, i])
    return out


def node(text: Column) -> Column:
    """What equal texts share; null for texts without words."""
    return F.when(F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")), F.unhex(F.md5(text)))


def bands(nodes: DataFrame) -> DataFrame:
    """(node, bands, sig, weight) of rows (node, text), one row per distinct node; sig has a byte per
    coordinate and then the bands' keys, weight is the number of elements."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=STEP_BYTES, rows=STEP_ROWS):
            own = batch.column(0).to_pylist()
            once = np.array(sorted({n: i for i, n in reversed(list(enumerate(own)))}.values()), np.int64)
            batch = batch.take(pa.array(once))
            data, at = utf8(batch.column(1))
            element, row = weighted_elements(data, at)
            sig = signatures(element, row, batch.num_rows)
            keys = band_keys(sig).view(np.int64)
            # The high byte: the coordinate is made of the low ones.
            short = [x.tobytes() + k.tobytes() for x, k in zip((sig >> U(56)).astype(np.uint8), keys)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(
                pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel())),
                pa.array(short, pa.binary()), pa.array(np.bincount(row, minlength=batch.num_rows).astype(np.int64))],
                ["node", "bands", "sig", "weight"])

    made = nodes.mapInArrow(step, "node binary, bands array<long>, sig binary, weight long")
    return made.groupBy("node").agg(*[F.first(c).alias(c) for c in ("bands", "sig", "weight")])


def elements(nodes: DataFrame) -> DataFrame:
    """(node, elements): the sorted element hashes of rows (node, text), 8 bytes each."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=STEP_BYTES):
            element, row = weighted_elements(*utf8(batch.column(1)))
            order = np.lexsort((element, row))
            element, at = element[order], np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows))))
            own = [element[a:b].tobytes() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["node", "elements"])

    return nodes.select("node", "text").mapInArrow(step, "node binary, elements binary")


def jaccard(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Exact weighted Jaccard similarity of the shingles of two text columns, row by row."""
    keys, rows = [], len(a)
    for column in (a, b):
        element, row = weighted_elements(*utf8(column))
        keys.append((element + mix(row.astype(U)), row))
    both = np.concatenate((keys[0][0], keys[1][0]))
    order = np.argsort(both)
    same = both[order][1:] == both[order][:-1]  # elements are distinct within a text
    row = np.concatenate((keys[0][1], keys[1][1]))[order][1:][same]
    shared = np.bincount(row, minlength=rows)
    total = np.bincount(keys[0][1], minlength=rows) + np.bincount(keys[1][1], minlength=rows)
    return shared / np.maximum(total - shared, 1)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (node, leader) whose texts (node, text) are as similar as asked for."""
    joined = pairs.join(texts, "node").withColumnRenamed("text", "text_a").join(
        texts.select(F.col("node").alias("leader"), F.col("text").alias("text_b")), "leader")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for half in chunks(batches, "text_b", STEP_BYTES):
            for batch in chunks(iter([half]), "text_a", STEP_BYTES):
                kept = np.flatnonzero(jaccard(batch.column(2), batch.column(3)) >= similarity)
                yield batch.select(["node", "leader"]).take(pa.array(kept))

    return joined.select("node", "leader", "text_a", "text_b").mapInArrow(step, "node binary, leader binary")


def classes(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, cluster) of the texts that have a near-duplicate, from (node, text); cluster is a node."""
    spark = rows.sparkSession
    texts = rows.filter(F.col("node").isNotNull())
    made = stored(bands(texts), "bands")
    members = made.select("node", "weight", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stored(members.join(small_or_shuffled(stored(shared, "keys").select("key")), "key"), "members")
    some = small_or_shuffled(members.select("node").distinct())
    texts = stored(texts.join(some, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "texts")
    if members.isEmpty():
        return spark.createDataFrame([], "node binary, cluster binary")
    counts = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    central = members.join(counts, "key").groupBy("node").agg(F.sum("n").alias("shares"))
    leaders = members.join(central, "node").groupBy("key").agg(
        F.max_by("node", F.struct("shares", "node")).alias("leader"))
    led = members.join(small_or_shuffled(stored(leaders, "leaders")), "key")
    pairs = led.filter(F.col("node") != F.col("leader")).select("node", "leader").distinct()
    labels = _joined(None, stored(verified(pairs, texts, similarity), "links"))
    members = stored(still_open(members, labels), "open")
    if members.isEmpty():
        return labels
    # A node's buckets, BANDS at most, meet its signature and elements as one row.
    lists = stored(members.groupBy("node", "own", "weight").agg(
        F.collect_list(F.struct("key", "blocks", "parts", "asks")).alias("buckets")), "lists")
    exact = elements(texts.join(small_or_shuffled(lists.select("node")), "node", "left_semi"))
    signed = lists.join(made.select("node", "sig"), "node").join(exact, "node")
    return _joined(labels, stored(block_links(signed, similarity), "links"))


def still_open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (key, node, weight, own: their class) of the buckets that hold several classes, whether one
    lies outside its bucket's largest class (asks), and into how many blocks all of the bucket's members
    and those that ask (parts) are dealt."""
    own = members.select("key", "node", "weight").join(labels, "node", "left").select(
        "key", "node", "weight", F.coalesce("cluster", "node").alias("own"))
    own = stored(own, "own")
    mass = F.sum(F.col("weight") * 8 + 9 * COORDINATES)
    by_class = own.groupBy("key", "own").agg(F.count(F.lit(1)).alias("n"), mass.alias("mass"))
    keys = by_class.groupBy("key").agg(
        F.sum("n").alias("size"), F.sum("mass").alias("mass"), F.max(F.struct("n", "own", "mass")).alias("most")).filter(
        "size > most.n")

    def cut(rows: Column, mass: Column) -> Column:
        return F.greatest(F.ceil(rows / BLOCK), F.ceil(mass / BLOCK_BYTES)).cast("long")

    keys = keys.select("key", F.col("most.own").alias("largest"), cut(F.col("size"), F.col("mass")).alias("blocks"),
                       cut(F.col("size") - F.col("most.n"), F.col("mass") - F.col("most.mass")).alias("parts"))
    return own.join(small_or_shuffled(stored(keys, "keys")), "key").select(
        "key", "node", "weight", "own", "blocks", "parts", (F.col("own") != F.col("largest")).alias("asks"))


def block_links(nodes: DataFrame, similarity: float) -> DataFrame:
    """Links (node, leader) between similar texts of different classes that share an open bucket.

    Takes (node, own, weight, buckets, sig, elements).  One of two texts asks in every bucket that holds
    both, so the first one they share is enough.  A block leaves out links within what it has joined."""
    least = COORDINATES * similarity - DEVIATIONS * (COORDINATES * similarity * (1 - similarity)) ** 0.5
    # A block holds a part of a bucket's members and a part of its asking ones; each of both meets each once.
    place = F.xxhash64("node")

    def every(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))

    members = nodes.select("node", "own", "sig", "elements", F.explode("buckets").alias("b")).select(
        "node", "own", "sig", "elements", "b.*")
    rest = ["node", "own", "sig", "elements"]
    rows = members.select("key", F.pmod(place, F.col("blocks")).alias("block"), every(F.col("parts")).alias("part"),
                          F.lit(False).alias("turn"), *rest)
    rows = rows.union(members.filter("asks").select(
        "key", every(F.col("blocks")).alias("block"), F.pmod(place, F.col("parts")).alias("part"),
        F.lit(True).alias("turn"), *rest))
    group = ["key", "block", "part"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            # The last block may go on in the next batch.
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            if not table.num_rows:
                continue
            ids = [table.column(c).to_numpy() for c in group]
            new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1
            last = int(new[-1]) if len(new) else 0
            held = table.slice(last).to_batches()
            if last:
                yield found(table.slice(0, last), [0, *new.tolist()])
        if held:
            table = pa.Table.from_batches(held)
            yield found(table, [0, table.num_rows])

    def found(table: pa.Table, at: list[int]) -> pa.RecordBatch:
        sig = utf8(table.column("sig"))[0].reshape(-1, COORDINATES + 8 * BANDS)
        sig, bands = sig[:, :COORDINATES], sig[:, COORDINATES:]
        bands = np.ascontiguousarray(bands).view(np.int64)
        key, node = table.column("key").to_numpy(), table.column("node").combine_chunks()
        own = np.unique(utf8(table.column("own"))[0].reshape(-1, 16).view("S16").ravel(), return_inverse=True)[1].ravel()
        data, edge = utf8(table.column("elements"))
        element, edge = np.frombuffer(data.tobytes(), U), edge // 8
        turn = table.column("turn").to_numpy()
        left, right = [], []
        for low, high in zip(at, at[1:]):
            label = np.unique(own[low:high], return_inverse=True)[1].ravel()
            joined = np.arange(label.max() + 1)  # the class that stands for each class of the block
            others = np.flatnonzero(~turn[low:high])
            theirs, size, of = sig[low + others], np.diff(edge)[low + others], label[others]
            for i in np.flatnonzero(turn[low:high]):
                mine = element[edge[low + i]:edge[low + i + 1]]
                near = np.flatnonzero(joined[of] != joined[label[i]])
                near = near[np.minimum(size[near], len(mine)) >= similarity * np.maximum(size[near], len(mine))]
                agree = agreement(theirs[near], sig[low + i])
                near, agree = near[agree >= least], agree[agree >= least]
                shared = (bands[low + others[near]] == bands[low + i]).argmax(axis=1)
                here = bands[low + i][shared] == key[low]
                for j in near[here][np.argsort(-agree[here], kind="stable")].tolist():
                    if joined[of[j]] == joined[label[i]]:
                        continue
                    other = low + others[j]
                    if similar(mine, element[edge[other]:edge[other + 1]], similarity):
                        left.append(low + i)
                        right.append(other)
                        joined[joined == joined[of[j]]] = joined[label[i]]
        return pa.RecordBatch.from_arrays(
            [node.take(pa.array(np.array(x, np.int64))) for x in (left, right)], ["a", "b"])

    links = rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(step, "a binary, b binary")
    return links.select(F.least("a", "b").alias("node"), F.greatest("a", "b").alias("leader")).distinct()


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted arrays of distinct elements have at least this Jaccard similarity."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return False
    at = np.searchsorted(b, a)
    shared = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return shared / (len(a) + len(b) - shared) >= similarity


def agreement(sigs: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Coordinates on which each of some byte signatures agrees with another one."""
    lanes = (sigs == sig).view(np.uint64).sum(axis=1)  # eight sums of 40 at most
    return lanes.view(np.uint8).reshape(-1, 8).sum(axis=1, dtype=np.int64)


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, cluster) after further links (node, leader)."""
    if labels is not None:
        if links.isEmpty():
            return labels
        links = links.union(labels.select("node", F.col("cluster").alias("leader")))
    return stored(connected_components(links, "node", "leader").select(F.col("id").alias("node"), "cluster"), "labels")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, class_size) of every document; class_id is the smallest id of its class."""
    rows = docs.select("doc_id", "text", node(F.col("text")).alias("node"))
    labels = classes(rows.select("node", "text"), similarity)
    ids = stored(rows.select("doc_id", "node"), "ids")
    of = ids.join(labels, "node", "left").select("doc_id", "node", F.coalesce("cluster", "node").alias("class"))
    sizes = stored(of.filter(F.col("class").isNotNull()).groupBy("class").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")).filter("class_size > 1"), "classes")
    joined = of.join(small_or_shuffled(sizes), "class", "left")
    alone = F.col("class_size").isNull()
    return joined.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                         F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))


def without_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, that of the smallest id; documents without words all stay."""
    c = fresh(docs, "node_", "keep_")
    marked = docs.withColumn(c["node_"], node(F.col("text")))
    rows = marked.select("doc_id", "text", F.col(c["node_"]).alias("node"))
    labels = classes(rows.select("node", "text"), similarity)
    ids = stored(rows.filter(F.col("node").isNotNull()).select("doc_id", "node"), "ids")
    of = ids.join(labels, "node", "left").withColumn("class", F.coalesce("cluster", "node"))
    keepers = of.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("k"))
    keepers = keepers.select(F.col("k.node").alias(c["keep_"]), F.col("k.doc_id").alias(f"{c['keep_']}id"))
    kept = marked.join(keepers, (F.col(c["node_"]) == F.col(c["keep_"]))
                       & F.col("doc_id").eqNullSafe(F.col(f"{c['keep_']}id")), "left_semi")
    kept = kept.dropDuplicates([c["node_"], "doc_id"])
    return kept.union(marked.filter(F.col(c["node_"]).isNull())).drop(c["node_"])
