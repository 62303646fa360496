"""Prefix trie of conversations by union-find over sorted neighbours.

Every conversation becomes one row: the digests of its turns, 16 bytes each,
joined to a key.  The rows are range-placed and sorted by (key, id), so the
members of a trie node are neighbours, and the depth down to which two
neighbours agree (their LCP) is an edge between them.  A task joins the rows of
its range by these edges, deepest first, with union-find: before two components
join at depth l, the chains of both down to l are closed, which makes their
nodes, and the join itself makes the branching node at depth l.

Only nodes on the path of a range's first or last row can reach into another
range.  They stay open and are handed on, two paths a range with the sums of
what was closed below them: the contracted forest.  The same union-find over
these paths merges them across the boundaries.  The hash over the ids that end
in a node is fed range by range, so a group of copies is never held whole.

Sizes: a conversation is a row of about 30 bytes a turn; the merge sees two
rows' paths per range of the sort, not per conversation.  Texts are reduced to
digests (first 16 bytes of SHA-256) before they are shuffled.

Defined cases: null roles and texts are empty strings; a null turn comes first;
rows with one turn number are ordered by role, then by
digest; repeated rows are
turns of their own; rows without conversation id are left out; an empty table
gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specengine.llm.common import small_or_shuffled, stored
from specengine.session import shuffle_partitions

#: Bytes of a turn's digest.
DIGEST = 16
#: Conversations that share their opening, and the most turns of it.
HOSTED, OPENING = 100, 6
#: Turns per range of the sort, about; a task holds the digests of one range.
RANGE_TURNS = 400_000

NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string")
#: What a range hands on.  A closed node is whole, but for the parent's id where the parent is open: that one has the
#: place (part, parent_side, depth - 1).  An open node has the place (part, side, depth) and what was closed below it.
FOREST = NODE + ", part int, parent_side int, side int, digest binary, length long, ends binary"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as digests and lengths in code points."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    bounded = F.concat(F.lpad(F.hex(F.octet_length(role)), 16, "0"), role, text)
    return turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(
            F.col("turn").alias("turn"), role.alias("role"),
            F.substring(F.unhex(F.sha2(bounded, 256)), 1, DIGEST).alias("digest"),
            F.length(text).cast("long").alias("length")).alias("t")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list("t")).alias("t")).select("conv_id", F.transform(
            "t", lambda t: F.struct(t.digest.alias("digest"), t.length.alias("length"))).alias("turns"))


def opening_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from its host: CRC-32 of the decimal id modulo OPENING."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % OPENING).cast("int")


def hosted(convs: DataFrame) -> DataFrame:
    """Conversations rebuilt: the opening of the host, which is the round id below, then the own turns after as many."""
    openings = convs.filter(F.col("conv_id") % HOSTED == 0).select(
        F.col("conv_id").alias("host"), F.slice("turns", 1, OPENING - 1).alias("opening"))
    none = F.slice("turns", 1, 0)
    # A host has fewer than 2 * HOSTED conversations (those around id 0), so no key of this join is hot.
    return convs.withColumn("host", F.col("conv_id") - F.col("conv_id") % HOSTED).withColumn(
        "h", opening_turns(F.col("conv_id"))).join(openings, "host", "left").select("conv_id", F.concat(
            F.slice(F.coalesce("opening", none), F.lit(1), F.col("h")),
            F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


@dataclass(slots=True)
class _Counts:
    """What is known of one node, or of a component's node while it grows."""

    n: int = 0
    least: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    #: Decimal ids of the conversations that end here, in pieces.
    ends: list[bytes] = field(default_factory=list)
    #: Closed nodes that are told this node's id once it is known, and the (part, side) places of this node.
    waiting: list[int] = field(default_factory=list)
    places: list[tuple[int, int]] = field(default_factory=list)

    def add(self, other: _Counts) -> None:
        self.n += other.n
        if other.least is not None and (self.least is None or other.least < self.least):
            self.least = other.least
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends += other.ends
        self.waiting += other.waiting
        self.places += other.places


@dataclass(slots=True)
class _Path:
    """A conversation's path from the root, and by depth what is counted there before any joins."""

    key: bytes
    lengths: Sequence[int]
    counts: dict[int, _Counts]


@dataclass(slots=True)
class _Component:
    """Neighbours joined so far, `first` to `last`: the path and depth of the node they share, and its counts."""

    path: _Path
    depth: int
    first: int
    last: int
    now: _Counts
    #: Paths that have counts at lesser depths.
    more: list[_Path]

    def arrive(self) -> None:
        """Take in what the paths have counted at this depth."""
        for p in self.more:
            if (found := p.counts.pop(self.depth, None)) is not None:
                self.now.add(found)
        self.more = [p for p in self.more if p.counts]


def agreeing(a: bytes, b: bytes) -> int:
    """Leading turns that two keys share."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // DIGEST
    x, y = np.frombuffer(a[:most], np.uint8), np.frombuffer(b[:most], np.uint8)
    return int(np.argmax(x != y)) // DIGEST


def _hashed(ends: list[bytes]) -> str:
    state = hashlib.sha256()
    for i, piece in enumerate(ends):
        state.update(b"," + piece if i else piece)
    return state.hexdigest()


_NO_ENDS = _hashed([])


class _Forest:
    """Union-find over sorted paths, by their LCP edges in descending depth.

    With `bounded` all members of every node are among the paths; else nodes on
    the first or last path stay open.
    """

    def __init__(self, paths: list[_Path], bounded: bool):
        self.paths, self.bounded = paths, bounded
        #: Closed nodes by column: conv_id, depth, parent, n, children, leaves, saved, side of an open parent.
        self.closed = [array("q") for _ in range(8)]
        self.ends: list[str] = []
        #: (depth, side, counts, path) of open nodes, and (conv_id, depth, part, side) of closed nodes with places.
        self.open: list[tuple[int, int, _Counts, _Path]] = []
        self.placed: list[tuple[int, int, int, int]] = []
        self.root = self._grow()

    def _close(self, c: _Component) -> int:
        """Close the node a component is at; returns its number."""
        now = c.now
        length = int(c.path.lengths[c.depth - 1]) if c.depth else 0
        number = len(self.ends)
        for column, value in zip(self.closed, (
                now.least, c.depth, -1, now.n, now.children, now.leaves if now.children else 1,
                now.saved + (now.n - 1) * length, -1)):
            column.append(value)
        self.ends.append(_hashed(now.ends) if now.ends else _NO_ENDS)
        for i in now.waiting:
            self.closed[2][i] = now.least
        self.placed += [(now.least, c.depth, part, side) for part, side in now.places]
        return number

    def _lift(self, c: _Component, to: int) -> None:
        """Close the chain above depth `to`, every node passing its sums on to the one above."""
        while c.depth > to:
            if not self.bounded and (c.first == 0 or c.last == len(self.paths) - 1):
                self.open.append((c.depth, 0 if c.first == 0 else 1, c.now, c.path))
                c.now = _Counts()
            else:
                i = self._close(c)
                c.now = _Counts(c.now.n, c.now.least, 1, self.closed[5][i], self.closed[6][i], [], [i])
            c.depth -= 1
            c.arrive()

    def _grow(self) -> _Component:
        found = []
        for i, p in enumerate(self.paths):
            c = _Component(p, len(p.key) // DIGEST, i, i, _Counts(), [p])
            c.arrive()
            found.append(c)
        above = list(range(len(found)))

        def top(i: int) -> int:
            while above[i] != i:
                above[i] = above[above[i]]
                i = above[i]
            return i

        edges = np.array([agreeing(a.key, b.key) for a, b in zip(self.paths, self.paths[1:])], np.int64)
        for e in np.argsort(-edges, kind="stable").tolist():
            i, j = top(e), top(e + 1)
            left, right = found[i], found[j]
            self._lift(left, int(edges[e]))
            self._lift(right, int(edges[e]))
            left.now.add(right.now)  # the joined components meet in a branching node
            left.more += right.more
            left.last = right.last
            above[j], found[j] = i, None
        whole = found[top(0)]
        self._lift(whole, 0)
        if self.bounded:
            self._close(whole)
        else:
            self.open.append((0, 0, whole.now, whole.path))
        return whole


_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
    ("part", pa.int32()), ("parent_side", pa.int32()), ("side", pa.int32()), ("digest", pa.binary()),
    ("length", pa.int64()), ("ends", pa.binary())])


def _batch(columns: dict[str, object], rows: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _ARROW], schema=_ARROW)


def _closed(forest: _Forest, part: int | None, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Closed nodes; one that still waits for its parent's id has that parent's side instead."""
    columns = [np.frombuffer(c, np.int64) if len(c) else np.zeros(0, np.int64) for c in forest.closed]
    for first in range(0, len(forest.ends), size):
        own = slice(first, first + size)
        conv, depth, parent, n, children, leaves, saved, side = (c[own] for c in columns)
        unknown = (side >= 0) | (depth == 0)
        yield _batch({
            "conv_id": conv, "depth": depth, "parent_conv_id": pa.array(parent, mask=unknown), "n_convs": n,
            "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": forest.ends[own],
            "parent_side": side.astype(np.int32), "part": np.full(len(conv), -1 if part is None else part, np.int32),
        }, len(conv))


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of a sorted range of (conv_id, key, lengths, part)."""
    paths: list[_Path] = []
    members: list[list[int]] = []
    part = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column(3)[0].as_py()
        lengths = batch.column(2)
        at, flat = lengths.offsets.to_numpy(), lengths.values.to_numpy(zero_copy_only=False)
        for i, (conv, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if not paths or paths[-1].key != key:
                paths.append(_Path(key, flat[at[i]:at[i + 1]], {}))
                members.append([])
            members[-1].append(conv)
    if part is None:
        return
    for p, own in zip(paths, members):
        p.counts[len(p.key) // DIGEST] = _Counts(len(own), min(own), ends=[",".join(map(str, own)).encode()])
    forest = _Forest(paths, bounded=False)
    for _, side, counts, _ in forest.open:
        for i in counts.waiting:
            forest.closed[7][i] = side
    yield from _closed(forest, part)
    for depth, side, c, path in forest.open:
        yield _batch({
            "conv_id": [c.least], "depth": [depth], "n_convs": [c.n], "n_children": [c.children], "n_leaves": [c.leaves],
            "saved_tokens": [c.saved], "part": [part], "side": [side], "ends": [b",".join(c.ends)],
            "digest": [path.key[(depth - 1) * DIGEST:depth * DIGEST] if depth else b""],
            "length": [path.lengths[depth - 1] if depth else 0]}, 1)


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the open nodes of all ranges, sorted by (part, side, depth).

    Gives the nodes, and for each place of an open node a row with part and side and the node's conv_id.
    """
    paths: list[_Path] = []
    at = None
    for batch in batches:
        for row in batch.to_pylist():
            if at != (row["part"], row["side"]):
                # The second path of a range goes on from the first one's node above its own first.
                shared = row["depth"] - 1 if row["side"] else 0
                before = paths[-1] if shared else _Path(b"", [], {})
                paths.append(_Path(before.key[:shared * DIGEST], before.lengths[:shared], {}))
                at = (row["part"], row["side"])
            path = paths[-1]
            if row["depth"]:
                path.key += row["digest"]
                path.lengths.append(row["length"])
            path.counts[row["depth"]] = _Counts(
                row["n_convs"], row["conv_id"], row["n_children"], row["n_leaves"], row["saved_tokens"],
                [row["ends"]] if row["ends"] else [], [], [at])
    if not paths:
        return
    forest = _Forest(paths, bounded=True)
    yield from _closed(forest, None)
    for first in range(0, len(forest.placed), 10_000):
        conv, depth, part, side = zip(*forest.placed[first:first + 10_000])
        yield _batch({"conv_id": conv, "depth": depth, "part": part, "side": side}, len(conv))


def trie(convs: DataFrame, ranges: int) -> DataFrame:
    """One row per trie node of (conv_id, turns: array of (digest, length)), ids being distinct."""
    rows = convs.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t.digest)), "")).alias("key"),
        F.transform("turns", lambda t: t.length).alias("lengths"))
    placed = rows.repartitionByRange(ranges, "key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn(
        "part", F.spark_partition_id())
    forest = stored(placed.mapInArrow(contracted, FOREST), "trie-forest")
    closed = forest.filter(F.col("side").isNull())
    joined = stored(forest.filter(F.col("side").isNotNull()).repartition(1).sortWithinPartitions(
        "part", "side", "depth").mapInArrow(merged, FOREST), "trie-joined")
    places = joined.filter(F.col("side").isNotNull()).select(
        "part", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"),
        F.col("conv_id").alias("parent_conv_id"))
    names = [part.split()[0] for part in NODE.split(", ")]
    return closed.filter(F.col("parent_side") < 0).select(*names).unionByName(
        closed.filter(F.col("parent_side") >= 0).drop("parent_conv_id").join(
            small_or_shuffled(places), ["part", "parent_side", "depth"]).select(*names)).unionByName(
        joined.filter(F.col("side").isNull()).select(*names))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie over the rebuilt conversations of a table of turns (conv_id, turn, role, text)."""
    rows = turns.select("conv_id", "turn", "role", "text")
    ranges = max(shuffle_partitions(rows), -(-rows.count() // RANGE_TURNS))
    return trie(hosted(conversations(rows)), ranges)


#: CRC-32 of an id's decimal text, bit by bit over its bytes (reflected polynomial 0xEDB88320).
_CRC = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, w: xor(v >> 1, 3988292384 * (v & 1)))))"""

TRIE_SQL = f"""
WITH own AS (
    SELECT conv_id, role, txt, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(printf('%016X', strlen(role)) || role || txt)) AS pos
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt
          FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (
    SELECT conv_id, conv_id - conv_id % {HOSTED} AS host, {_CRC} % {OPENING} AS h
    FROM (SELECT DISTINCT conv_id FROM own)),
rebuilt AS (
    SELECT ids.conv_id, 0 AS side, pos, role, txt FROM ids JOIN own ON own.conv_id = host AND pos <= h
    UNION ALL
    SELECT ids.conv_id, 1, pos, role, txt FROM ids JOIN own ON own.conv_id = ids.conv_id AND pos > h),
numbered AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY side, pos) AS depth,
           sha256(printf('%016X', strlen(role)) || role || txt) AS turn_hash, length(txt) AS chars
    FROM rebuilt),
member AS (
    SELECT conv_id, 0 AS depth, '' AS prefix, 0 AS chars FROM ids
    UNION ALL
    SELECT conv_id, depth, string_agg(turn_hash, '') OVER (
        PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING), chars FROM numbered),
node AS (
    SELECT min(conv_id) AS conv_id, depth, prefix, count(*) AS n_convs, max(chars) AS chars,
           string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = total) AS ends
    FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS total FROM member) GROUP BY depth, prefix),
child AS (
    SELECT above.depth, above.prefix, count(*) AS n_children
    FROM node JOIN member AS above ON above.conv_id = node.conv_id AND above.depth = node.depth - 1
    GROUP BY above.depth, above.prefix),
whole AS (
    SELECT node.*, coalesce(n_children, 0) AS n_children
    FROM node LEFT JOIN child ON child.depth = node.depth AND child.prefix = node.prefix),
below AS (
    SELECT above.depth, above.prefix, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
           sum((n_convs - 1) * whole.chars) AS saved
    FROM whole JOIN member AS above ON above.conv_id = whole.conv_id AND above.depth <= whole.depth
    GROUP BY above.depth, above.prefix)
SELECT whole.conv_id::BIGINT AS conv_id, whole.depth::BIGINT AS depth, parent.conv_id::BIGINT AS parent_conv_id,
       whole.n_convs::BIGINT AS n_convs, whole.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
       saved::BIGINT AS saved_tokens, sha256(coalesce(whole.ends, '')) AS ends_sha256
FROM whole JOIN below ON below.depth = whole.depth AND below.prefix = whole.prefix
LEFT JOIN member AS up ON up.conv_id = whole.conv_id AND up.depth = whole.depth - 1
LEFT JOIN node AS parent ON parent.depth = up.depth AND parent.prefix = up.prefix
"""
