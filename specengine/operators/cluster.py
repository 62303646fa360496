"""Spectrum clustering in passes.

Clusters are the components of a similarity graph, so no order of rows or split
of groups changes them.  Similarity is the normalised dot product of
square-root intensities in whole-Dalton bins; that choice is ours.

The graph is never written out.  Its links are found by an exact similarity
join with prefix and size filters, and every group of the join gives stars.
The filters, for unit vectors whose bins are ranked from the rarest to the most
frequent one and a least similarity t:

* Two vectors of similarity t share a bin in both of their prefixes, a prefix
  ending where the norm of the rest falls below t.  So a vector goes to the
  groups of its prefix bins only, which are its rare ones.
* All that two vectors share lies behind their first shared bin, so in the
  group of that bin the product of the norms from there on is t at least.  This
  empties the groups of bins that nearly every spectrum has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from specengine.operators.filters import checked_small
from specengine.operators.skew import salted_join
from specengine.session import store

MAJOR_PEAKS = 6
MZ_LIMIT = 10_000.0
MZ_WINDOW = 1.0
SIMILARITY = 0.6
BLOCK_WINDOWS = 4
#: Members of a part of a crowded group; a comparison holds two parts.
MEMBERS_PER_PART = 2_000
#: Pairs per member up to which a group's pairs with two shared bins are listed; beyond, they are found member by member.
PAIRS_PER_MEMBER = 200
#: Pairs that are listed at a time.
PAIRS_AT_ONCE = 1_000_000
#: Links that one task joins by union-find; more are joined by rounds over all tasks.
LINKS_PER_TASK = 500_000
#: Products are rounded so, and bounds are held back by as much.
DIGITS, SLACK = 9, 1e-9


def bin_rows(spectra: DataFrame) -> DataFrame:
    """(id, precursor_mz, bin, w): square-root intensity per whole Dalton."""
    return spectra.select("id", F.col("precursor.mz").alias("precursor_mz"), F.explode("peaks").alias("p")).groupBy(
        "id", "precursor_mz", F.col("p.mz").cast("int").alias("bin")).agg(
        F.sqrt(F.sum("p.intensity")).alias("w")).filter("w > 0")


def binned_vectors(spectra: DataFrame) -> DataFrame:
    """(id, precursor_mz, bins, weights): unit-length square-root intensities per whole Dalton."""
    return _vectors(bin_rows(spectra))


def _vectors(rows: DataFrame) -> DataFrame:
    listed = rows.groupBy("id", "precursor_mz").agg(
        F.array_sort(F.collect_list(F.struct("bin", "w"))).alias("l"),
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return listed.select(
        "id", "precursor_mz", F.transform("l", lambda x: x.bin).alias("bins"),
        F.transform("l", lambda x: x.w / F.col("norm")).alias("weights"))


def peak_keys(vectors: DataFrame, n: int = MAJOR_PEAKS, limit: float = MZ_LIMIT) -> DataFrame:
    """One row per major peak (whole m/z) of every spectrum below the precursor limit."""
    ranked = F.slice(F.array_sort(F.transform(
        F.arrays_zip("bins", "weights"),
        lambda x: F.struct((-x.weights).alias("w"), x.bins.alias("bin")))), 1, n)
    return vectors.filter(F.col("precursor_mz") < limit).withColumn(
        "key", F.explode(F.transform(ranked, lambda x: x.bin.cast("long"))))


def ranked_vectors(rows: DataFrame, similarity: float = SIMILARITY, majors: int | None = None) -> DataFrame:
    """(id, precursor_mz, bins, weights, major, prefix): vectors of (id, precursor_mz, bin, w) with their filters.

    `major` tells for each bin whether it is among the `majors` largest (None:
    all are).  `prefix` has (key, rest): the prefix bins with the norm from
    there on.  Any ranking of the bins gives the same links.
    """
    frequency = checked_small(rows.groupBy("bin").agg(F.count(F.lit(1)).alias("_f")))  # one row per whole Dalton
    from_common = W.partitionBy("id").orderBy(F.desc("_f"), F.desc("bin"))
    largest = W.partitionBy("id").orderBy(F.desc("w"), "bin")
    square = F.col("w") * F.col("w")
    found = rows.join(frequency, "bin").select(
        "id", "precursor_mz", "bin", "w", F.sum(square).over(from_common).alias("_rest"),
        (F.lit(True) if majors is None else F.row_number().over(largest) <= majors).alias("major"))
    listed = found.groupBy("id", "precursor_mz").agg(
        F.array_sort(F.collect_list(F.struct("bin", "w", "major", "_rest"))).alias("l"), F.sum(square).alias("_all"))
    rest = F.transform("l", lambda x: F.struct(x.bin.alias("key"), F.sqrt(x["_rest"] / F.col("_all")).alias("rest")))
    return listed.select(
        "id", "precursor_mz", F.transform("l", lambda x: x.bin).alias("bins"),
        F.transform("l", lambda x: x.w / F.sqrt("_all")).alias("weights"),
        F.transform("l", lambda x: x.major).alias("major"),
        F.filter(rest, lambda x: x.rest >= similarity * (1 - SLACK)).alias("prefix"))


def alike(vectors: DataFrame, window: float) -> tuple[DataFrame, DataFrame]:
    """Equal vectors in one cell of m/z, a window wide, become one node: (nodes, links id to leader).

    Members of a cell lie within the window of each other, so they are one
    component, and the node needs its first and last m/z only: neighbours in it
    are no farther apart than the window, so another node has a member within
    the window of one of them exactly if it lies within the window of that
    range.
    """
    cell = F.floor(F.col("precursor_mz") / window).cast("long")
    keyed = vectors.withColumns({
        "_cell": cell, "_h": F.xxhash64("bins", "weights", "major"), "_g": F.xxhash64(F.lit(1), "weights", "bins")})
    nodes = keyed.groupBy("_cell", "_h", "_g").agg(
        F.min("id").alias("id"), F.min("precursor_mz").alias("lo"), F.max("precursor_mz").alias("hi"),
        *[F.first(c).alias(c) for c in ("bins", "weights", "major", "prefix")], F.count(F.lit(1)).alias("_n"))
    several = nodes.filter("_n > 1").select("_cell", "_h", "_g", F.col("id").alias("leader"))
    copies = salted_join(keyed.select("id", "_cell", "_h", "_g"), several, ["_cell", "_h", "_g"]).select("id", "leader")
    return nodes.drop("_cell", "_h", "_g", "_n"), copies


def star_links(nodes: DataFrame, window: float = MZ_WINDOW, similarity: float = SIMILARITY,
               rows_per_task: int = MEMBERS_PER_PART) -> DataFrame:
    """Links (id, leader) between similar nodes (id, lo, hi, bins, weights, major, prefix) within the window.

    Two nodes are linked if their similarity is large enough and they share a
    major bin.  They meet in the group of their first shared prefix bin and m/z
    block.  Of a group of more than `rows_per_task` members those go that reach
    the similarity with no other member by the norms; the rest is dealt into
    parts by the hash of the id, and every two parts meet.  A comparison
    returns stars, one for each component that it finds, never pairs.
    """
    width = window * BLOCK_WINDOWS
    blocks = nodes.withColumn("block", F.explode(F.sequence(
        F.floor(F.col("lo") / width).cast("long"), F.floor((F.col("hi") + window * (1 + SLACK)) / width).cast("long")))).withColumn(
        "_p", F.explode("prefix")).select(
        F.col("_p.key").alias("key"), "block", F.col("_p.rest").alias("rest"), "id", "lo", "hi", "bins", "weights", "major")
    group = ["key", "block"]
    sizes = blocks.select(*group, "id", "rest")
    crowded = checked_small(sizes.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), F.max("rest").alias("_first"),
        F.expr("max_by(id, rest)").alias("_top")).filter(F.col("_n") > rows_per_task).select(*group, "_first", "_top"))
    # The member of the largest norm meets itself only, so it stays too if any other does.
    stays = F.col("_first").isNull() | (F.col("rest") * F.col("_first") >= similarity * (1 - SLACK))
    left = sizes.join(crowded, group, "left").filter(stays & F.col("_first").isNotNull()).groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_task).select(
        *group, F.ceil(F.col("_n") / rows_per_task).alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1)).cast("long")
    numbers = F.sequence(F.lit(0).cast("long"), parts - 1)
    cells = blocks.join(crowded, group, "left").filter(stays).join(checked_small(left), group, "left").withColumn(
        "_own", F.pmod(F.xxhash64("id"), parts)).withColumn(
        "_other", F.explode(F.when(parts == 1, numbers).otherwise(F.array_remove(numbers, F.col("_own"))))).select(
        *group, F.least("_own", "_other").cast("int").alias("a"), F.greatest("_own", "_other").cast("int").alias("b"),
        "lo", "hi", "rest", "id", "bins", "weights", "major")
    order = [*group, "a", "b"]
    placed = cells.repartition(*order).sortWithinPartitions(*order, "lo", "id")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            starts = _group_starts([table.column(c) for c in order])
            last = int(starts[-1]) if len(starts) else 0
            held = table.slice(last)
            if last:
                yield _stars(table.slice(0, last), starts[:-1], window, similarity)
        if held is not None and held.num_rows:
            yield _stars(held, np.zeros(1, np.int64), window, similarity)

    id_type = nodes.schema["id"].dataType.simpleString()
    return placed.mapInArrow(link, f"id {id_type}, leader {id_type}").distinct()


def _group_starts(keys: list[pa.ChunkedArray]) -> np.ndarray:
    """Places at which the sorted key rows change, the first place included."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for k in keys:
        values = k.to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, offsets) of a column of lists."""
    column = column.combine_chunks()
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]], at - at[0]


def _stars(table: pa.Table, starts: np.ndarray, window: float, similarity: float) -> pa.RecordBatch:
    """Links of the groups that begin at the given places; members are in order of their first m/z."""
    n = table.num_rows
    lo, hi, rest = (table.column(c).to_numpy() for c in ("lo", "hi", "rest"))
    bins, at = _lists(table.column("bins"))
    weights, _ = _lists(table.column("weights"))
    major, _ = _lists(table.column("major"))
    size = np.diff(np.append(starts, n))
    group = np.repeat(np.arange(len(starts)), size)
    leader = np.arange(n)
    crowded = _link_few(leader, np.arange(n), group, lo, hi, rest, bins, weights, major, at, window, similarity,
                        table.column("key").to_numpy(), PAIRS_PER_MEMBER)
    for s, m in zip(starts[crowded].tolist(), size[crowded].tolist()):
        _link_many(leader, s, s + m, lo, hi, rest, bins, weights, major, at, window, similarity)
    ids = table.column("id").combine_chunks()
    linked = np.flatnonzero(leader != np.arange(n))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(linked)), ids.take(pa.array(leader[linked]))], ["id", "leader"])


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of several ranges, one after another."""
    size = np.maximum(end - start, 0)
    return np.arange(size.sum()) + np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size)


def _link_few(leader, rows, group, lo, hi, rest, bins, weights, major, at, window, similarity, key=None,
              per_member=np.inf) -> np.ndarray:
    """Many groups at once: what shares its group's bin (`key`) only is linked by that weight, other pairs are listed.

    Groups, numbered upwards in order of the rows, that have more than `per_member` listed pairs for each member are
    returned and left alone.
    """
    n_groups = int(group.max()) + 1
    length = at[rows + 1] - at[rows]
    entry, member = _ranges(at[rows], at[rows + 1]), np.repeat(rows, length)
    group_of = np.zeros(len(leader), np.int64)
    group_of[rows] = group
    key_weight, key_major = np.zeros(len(leader)), np.zeros(len(leader), bool)
    if key is not None:
        own = bins[entry] == key[member]
        key_weight[member[own]], key_major[member[own]] = weights[entry[own]], major[entry[own]]
        entry, member = entry[~own], member[~own]
    owner = np.zeros(len(bins), np.int64)
    owner[entry] = member
    entry, run = _shared_runs(entry, group_of[member], bins[entry])
    pairs, group_of_entry = _later(run), group_of[owner[entry]]
    crowded = np.bincount(group_of_entry, pairs, n_groups) > per_member * np.bincount(group, minlength=n_groups)
    near = lambda a, b: lo[b] - hi[a] <= window  # noqa: E731  (a comes first)
    _link_by_key(leader, rows[~crowded[group]], group_of, key_weight, key_major, hi, near, similarity)
    taken = ~crowded[group_of_entry]
    _link_by_more(leader, entry[taken], pairs[taken], owner, group_of, weights, major, key_weight, key_major, near, similarity)
    return np.flatnonzero(crowded)


def _shared_runs(entry: np.ndarray, group: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries in order of (group, bin, member) whose bin another member of the group has too, and the size of their runs."""
    order = np.lexsort((entry, bins, group))
    entry, group, bins = entry[order], group[order], bins[order]
    if not len(entry):
        return entry, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (bins[1:] != bins[:-1]))))
    size = np.diff(np.append(first, len(entry)))
    shared = np.repeat(size > 1, size)
    return entry[shared], size[size > 1]


def _later(run: np.ndarray) -> np.ndarray:
    """For each entry of runs of these sizes the number of entries of its run that come after it."""
    return np.repeat(np.cumsum(run), run) - np.arange(run.sum()) - 1


def _pieces(cost: np.ndarray, unit: np.ndarray) -> Iterator[slice]:
    """Slices of about PAIRS_AT_ONCE pairs; entries of one unit stay together."""
    if not len(cost):
        return
    piece = np.cumsum(cost) // PAIRS_AT_ONCE
    first = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
    cuts = first[np.concatenate(([True], piece[first][1:] != piece[first][:-1]))]
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(cost)]):
        yield slice(a, b)


def _settle(leader: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Let linked members, and what they were linked to before, have the least of their leaders."""
    a, b = leader[a], leader[b]
    while len(a):
        least = np.minimum(leader[a], leader[b])
        before = leader.copy()
        for x in (a, b, before[a], before[b]):
            np.minimum.at(leader, x, least)
        leader[:] = leader[leader]
        if (leader == before).all():
            break


def _link_by_key(leader, rows, group, weight, major, hi, near, similarity) -> None:
    """Links of members whose weights in the bin of their group suffice alone.

    Any two strong members, whose squares reach the similarity, are similar, so
    those that are near each other are a component: each is linked to the one
    before it that reaches farthest.  A weaker member needs a strong one.
    """
    rows = rows[major[rows]]
    alone = np.round(weight[rows] * weight[rows], DIGITS) >= similarity
    strong, weak = rows[alone], rows[~alone & (np.round(weight[rows], DIGITS) >= similarity)]
    if not len(strong):
        return
    by_reach = np.argsort(hi[strong], kind="stable")
    rank = np.empty(len(strong), np.int64)
    rank[by_reach] = np.arange(len(strong))
    farthest = strong[by_reach[np.maximum.accumulate(group[strong] * len(strong) + rank) % len(strong)]]
    a, b = farthest[:-1], strong[1:]
    linked = (group[a] == group[b]) & near(a, b)
    _settle(leader, a[linked], b[linked])
    begin, end = (np.searchsorted(group[strong], group[weak], side) for side in ("left", "right"))
    for part in _pieces(end - begin, weak):
        x, y = np.repeat(weak[part], (end - begin)[part]), strong[_ranges(begin[part], end[part])]
        found = np.round(weight[x] * weight[y], DIGITS) >= similarity
        x, y = x[found], y[found]
        x, y = np.minimum(x, y), np.maximum(x, y)
        linked = near(x, y)
        _settle(leader, x[linked], y[linked])


def _link_by_more(leader, entry, pairs, owner, group, weights, major, key_weight, key_major, near, similarity) -> None:
    """Links of members that share another bin besides that of their group."""
    owner = owner[entry]
    for part in _pieces(pairs, group[owner]):
        left = np.repeat(np.arange(part.start, part.stop), pairs[part])
        right = _ranges(np.arange(part.start, part.stop) + 1, np.arange(part.start, part.stop) + 1 + pairs[part])
        kept = near(owner[left], owner[right])
        left, right = left[kept], right[kept]
        if not len(left):
            continue
        pair = owner[left] * np.int64(len(leader)) + owner[right]
        order = np.argsort(pair, kind="stable")
        pair, left, right = pair[order], entry[left[order]], entry[right[order]]
        first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        a, b = pair[first] // len(leader), pair[first] % len(leader)
        product = np.add.reduceat(weights[left] * weights[right], first) + key_weight[a] * key_weight[b]
        shared = np.logical_or.reduceat(major[left] & major[right], first) | (key_major[a] & key_major[b])
        linked = (np.round(product, DIGITS) >= similarity) & shared
        _settle(leader, a[linked], b[linked])


def _link_many(leader, start, end, lo, hi, rest, bins, weights, major, at, window, similarity) -> None:
    """A group of much in common: products of one member with those behind it, unless they are of its component already."""
    n = end - start
    first = at[start]
    entry = np.arange(first, at[end])
    member = np.repeat(np.arange(n), np.diff(at[start:end + 1]))
    order = np.lexsort((member, bins[entry]))
    used, column = np.unique(bins[entry], return_inverse=True)
    stop = np.cumsum(np.bincount(column, minlength=len(used)))
    ahead = np.concatenate(([0], stop[:-1]))  # the first entry of a bin that isn't done yet
    posted, posted_weight, posted_major = member[order], weights[entry][order], major[entry][order]
    component = np.arange(n)
    reach = np.searchsorted(lo[start:end], hi[start:end] + window * (1 + SLACK), "right")
    for x in range(n):
        mine = slice(at[start + x] - first, at[start + x + 1] - first)
        ahead[column[mine]] += 1
        last = reach[x]
        asked = component[x + 1:last] != component[x]
        asked &= lo[start + x + 1:start + last] - hi[start + x] <= window
        asked &= rest[start + x] * rest[start + x + 1:start + last] >= similarity * (1 - SLACK)
        if not asked.any():
            continue
        begin, finish = ahead[column[mine]], stop[column[mine]]
        found = _ranges(begin, finish)
        size = finish - begin
        other = posted[found] - x - 1
        product = np.bincount(other, np.repeat(weights[entry][mine], size) * posted_weight[found], n - x - 1)
        shared = np.bincount(other, np.repeat(major[entry][mine], size) & posted_major[found], n - x - 1)
        hits = asked & (np.round(product[:last - x - 1], DIGITS) >= similarity) & (shared[:last - x - 1] > 0)
        for c in np.unique(component[x + 1:last][hits]).tolist():
            component[component == c] = component[x]
    _, at_first, place = np.unique(component, return_index=True, return_inverse=True)
    leader[start:end] = start + at_first[place]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) to links (u, least of its component)."""
    above: dict = {}

    def top(x):
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    schema = None
    for batch in batches:
        schema = batch.schema
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = top(u), top(v)
            if x != y:
                above[max(x, y)] = min(x, y)
    if above:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(above), schema.field(0).type), pa.array([top(x) for x in above], schema.field(1).type)],
            schema=schema)


def connected_components(links: DataFrame, a: str = "id", b: str = "leader", max_rounds: int = 60,
                         links_per_task: int = LINKS_PER_TASK) -> DataFrame:
    """(id, cluster): the least id of each component.

    Up to `links_per_task` links, counted, are joined by one task.  More are
    joined by large-star and small-star rounds:

    Large star: every node links its larger neighbours to the least of its
    neighbours and itself.  Small star: it links its smaller neighbours and
    itself to the least of them.  Links never become more, and chains shrink
    by doubling, until the links stay the same or fit one task.  Least neighbours are combined before they are shuffled, and
    brought back to the links by a join that cuts hot nodes, so a component or
    a node of any size is spread over many tasks.  A round is stored in the
    shared folder.
    """
    links = store(links.select(a, b), "component-links")
    nodes = links.select(F.col(a).alias("id")).unionByName(links.select(F.col(b).alias("id"))).distinct()
    big, small = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    edges = store(links.filter(F.col(a) != F.col(b)).select(big.alias("u"), small.alias("v")).distinct(), "component-edges")
    state = _edge_state(edges)
    for _ in range(max_rounds):
        if state[0] <= links_per_task:
            edges = edges.repartition(1).mapInArrow(_joined, edges.schema)
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
        # Larger neighbours of a node: the links that have it as their smaller end.
        large = salted_join(edges.select(F.col("v").alias("u"), F.col("u").alias("_to")), least, ["u"]).select(
            F.col("_to").alias("u"), F.col("_m").alias("v")).distinct()
        large = store(large, "component-large")
        least = large.groupBy("u").agg(F.min("v").alias("_m"))
        pulled = salted_join(large, least, ["u"]).select(F.col("v").alias("u"), F.col("_m").alias("v"))
        edges = store(pulled.unionByName(least.select("u", F.col("_m").alias("v"))).filter("u <> v").distinct(), "component-edges")
        before, state = state, _edge_state(edges)
        if before == state:
            break
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    return store(nodes.join(edges.select(F.col("u").alias("id"), F.col("v").alias("cluster")), "id", "left").select(
        "id", F.coalesce("cluster", "id").alias("cluster")), "components")


def _edge_state(edges: DataFrame) -> tuple[int, int, int]:
    """Number of links and two sums of their hashes: equal for equal links."""
    parts = [F.coalesce(F.sum(F.xxhash64(F.lit(i), "u", "v").cast("decimal(38,0)")), F.lit(0)) for i in (1, 2)]
    row = edges.agg(F.count(F.lit(1)), *parts).first()
    return int(row[0]), int(row[1]), int(row[2])


def consensus_rows(spectra: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, precursor_mz, bin, w) of each cluster's summed spectrum, and (cluster, precursor_mz, n_members).

    The m/z is the members' mean.  Sums run per (cluster, bin), so a cluster of
    any size is combined before it is shuffled.
    """
    joined = spectra.join(clusters, "id")
    centre = joined.groupBy("cluster").agg(
        F.avg("precursor.mz").alias("precursor_mz"), F.count(F.lit(1)).alias("n_members"))
    rows = joined.select("cluster", F.explode("peaks").alias("p")).groupBy(
        "cluster", F.col("p.mz").cast("int").alias("bin")).agg(
        F.sqrt(F.sum("p.intensity")).alias("w")).filter("w > 0")
    return rows.join(centre, "cluster").select(F.col("cluster").alias("id"), "precursor_mz", "bin", "w"), centre


def consensus(spectra: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per cluster: mean precursor m/z and the summed, renormalised vector."""
    rows, centre = consensus_rows(spectra, clusters)
    return _vectors(rows).join(centre.select(F.col("cluster").alias("id"), "n_members"), "id")


def cluster_by_peak(spectra: DataFrame, window: float = MZ_WINDOW, similarity: float = SIMILARITY,
                    rows_per_task: int = MEMBERS_PER_PART) -> DataFrame:
    """First pass: (id, cluster) from links among spectra that share a major peak."""
    rows = bin_rows(spectra).filter(F.col("precursor_mz") < MZ_LIMIT)
    return _components_of(ranked_vectors(rows, similarity, MAJOR_PEAKS), window, similarity, rows_per_task)


def _components_of(vectors: DataFrame, window: float, similarity: float, rows_per_task: int = MEMBERS_PER_PART) -> DataFrame:
    vectors = store(vectors, "cluster-vectors")
    nodes, copies = alike(vectors, window)
    links = star_links(nodes, window, similarity, rows_per_task).unionByName(copies)
    return connected_components(links.unionByName(vectors.select("id", F.col("id").alias("leader"))))


def merge_bins(spectra: DataFrame, clusters: DataFrame, window: float,
               similarity: float = SIMILARITY) -> DataFrame:
    """Merge clusters whose consensus is similar and whose precursors lie within the window."""
    rows, _ = consensus_rows(spectra, clusters)
    merged = _components_of(ranked_vectors(rows, similarity), window, similarity).select(
        F.col("id").alias("cluster"), F.col("cluster").alias("_to"))
    return store(salted_join(clusters, merged, ["cluster"]).select("id", F.col("_to").alias("cluster")), "merged")


def cluster_spectra(spectra: DataFrame, window: float = MZ_WINDOW,
                    similarity: float = SIMILARITY) -> DataFrame:
    """All passes: by peak, merge in a quarter of the window, merge in the whole window."""
    clusters = cluster_by_peak(spectra, window, similarity)
    clusters = merge_bins(spectra, clusters, window / 4, similarity)
    return merge_bins(spectra, clusters, window, similarity)


def consolidate(spectra: DataFrame, clusters: DataFrame) -> DataFrame:
    """Cluster rows ready to be written by m/z: cluster, precursor_mz, mz_int, members, peaks."""
    return consensus(spectra, clusters).select(
        F.col("id").alias("cluster"), "precursor_mz",
        F.col("precursor_mz").cast("int").alias("mz_int"), "n_members", "bins", "weights")
