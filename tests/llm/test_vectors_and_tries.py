"""Nearest neighbours, whitening and the prefix trie against brute force, with odd rows."""

import hashlib
import math
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from specengine.llm import learned_partitions, prefix_trie, whitening
from specengine.llm.common import table

VECTORS = "vec_id long, embedding array<float>, label int"
TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def vectors(spark, folder):
    """Given vectors with rows that take no part, copies, a group of near copies and clashing columns."""
    given = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    random = np.random.default_rng(3)
    seed = random.standard_normal(64)
    odd = [(90001, None, 1), (90002, [], 1), (90003, [0.0] * 64, 1), (90004, [None] + [1.0] * 63, 1),
           (90005, [math.nan] * 64, 1), (90006, [math.inf] * 64, 1), (90007, [1.0, 2.0], 1), (None, [1.0] * 64, None)]
    copies = [(90100 + i, [0.5] * 64, 2) for i in range(60)]
    near = [(90200 + i, (seed + 0.01 * random.standard_normal(64)).tolist(), 3) for i in range(200)]
    again = [(90300, [0.25] * 64, 1), (90300, [0.25] * 64, 1), (90320, [2.0] * 64, 1), (90320, [1.0] * 64, 1)]
    return given.union(spark.createDataFrame(odd + copies + near + again, VECTORS)).withColumns(
        {"id": F.lit("x"), "part": F.lit(1), "x": F.lit(2), "vector": F.lit("v")}).cache()


def finite(rows, zero):
    for vec_id, v, *_ in rows:
        if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v) and (zero or any(v)):
            yield vec_id, v


def brute_neighbours(rows, k, every):
    best = {}
    for vec_id, v in finite(rows, False):
        if vec_id is not None:
            best[vec_id] = min(best.get(vec_id, v), v)
    ids = np.array(sorted(best))
    x = np.array([best[i] for i in ids], float)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        scores = (x[i].astype(np.longdouble) * x).sum(1).astype(float)
        scores[i] = -np.inf
        out[int(ids[i])] = [(int(ids[j]), scores[j]) for j in np.lexsort((ids, -scores))[:min(k, len(ids) - 1)]]
    return out


def found(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return dict(out)


def recall(got, want):
    return sum(len({a for a, _ in got[q]} & {a for a, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_neighbours_recall(vectors):
    want = brute_neighbours(vectors.select("vec_id", "embedding").collect(), 20, 20)
    got = found(learned_partitions.search(vectors, F.col("id") % 20 == 0))
    assert got.keys() == want.keys() and 90320 in got
    assert recall(got, want) >= 0.9
    scores = {q: dict(brute) for q, brute in brute_neighbours(
        vectors.select("vec_id", "embedding").collect(), 10**6, 20).items()}
    for q, listed in got.items():
        assert len(listed) == 20
        assert all(scores[q][v] == s for v, s in listed)
        assert listed == sorted(listed, key=lambda p: (-p[1], p[0]))
    assert [v for v, _ in got[90120]][:1] != [90120]


def test_neighbours_are_exact_in_one_part(vectors):
    want = brute_neighbours(vectors.select("vec_id", "embedding").collect(), 7, 20)
    # Small blocks on both sides: every query meets every row once.
    got = found(learned_partitions.search(vectors, F.col("id") % 20 == 0, k=7, max_parts=1, block_rows=50, block_queries=9))
    assert got == want
    again = found(learned_partitions.search(vectors.repartition(7), F.col("id") % 20 == 0, k=7))
    assert again == found(learned_partitions.search(vectors, F.col("id") % 20 == 0, k=7))


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1)], VECTORS)
    assert found(learned_partitions.search(df, F.col("id") % 20 == 0)) == {0: [(1, 1.0), (2, 0.0)]}
    assert learned_partitions.search(df.limit(1), F.col("id") % 20 == 0).count() == 0
    assert learned_partitions.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_parts_are_balanced():
    random = np.random.default_rng(5)
    x = np.concatenate((random.standard_normal((700, 8)), 4 + 0.1 * random.standard_normal((324, 8))))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argsort(-(x @ x.T), 1)[:, 1:11]
    part = learned_partitions.balanced_parts(near, x, 16)
    assert set(np.bincount(part)) == {64}
    cut = (part[near] != part[:, None]).mean()
    dealt = random.permutation(part)
    assert cut < 0.8 * (dealt[near] != dealt[:, None]).mean()


def brute_whitening(rows):
    x = np.floor(256 * np.array([v for _, v in rows], float))
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    centred = fit - total / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    return n, ((n * x - total) ** 2).sum(1), (x - total / n) @ u[:, :4] / np.sqrt(e[:4]), e[:4] / e.sum()


def test_whitening_is_an_eigendecomposition(vectors):
    rows = sorted((r for r in finite(vectors.select("vec_id", "embedding").collect(), True)),
                  key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    n, deviation, white, explained = brute_whitening(rows)
    out = whitening.whiten(vectors)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.toPandas()
    assert len(got) == 4 * len(rows) and set(got.component) == {1, 2, 3, 4}
    assert set(got.n) == {n} and got.identity_error.max() < 1e-9
    assert np.allclose(got.sort_values("component").explained.unique(), explained, rtol=1e-9)
    assert sorted(got[got.component == 1].deviation) == sorted(deviation.astype("int64"))
    for c in range(4):
        one = np.sort(got[got.component == c + 1].whitened)
        assert min(np.abs(one - np.sort(s * white[:, c])).max() for s in (1, -1)) < 1e-8
    one = got[(got.vec_id == 3)].sort_values("component")
    at = [i for i, r in enumerate(rows) if r[0] == 3][0]
    assert np.allclose(np.abs(one.whitened), np.abs(white[at]), atol=1e-9)


def test_pairs_of_a_close_spectrum():
    random = np.random.default_rng(1)
    u = np.linalg.qr(random.standard_normal((120, 120)))[0]
    e = np.concatenate(([1.0, 0.9999, 0.9998, 0.9], np.linspace(0.89, 0.01, 116)))
    a = (u * e) @ u.T
    values, vectors = whitening.leading_pairs(lambda block: a @ block, 120, 4)
    assert np.allclose(values, e[:4], rtol=1e-13)
    assert np.abs(np.abs((u[:, :4] * vectors).sum(0)) - 1).max() < 1e-12
    assert np.linalg.norm(a @ vectors - vectors * values) < 1e-13


def test_whitening_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, VECTORS)
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).count() == 0
    two = whitening.whiten(make([(1, [1.0, 2.0], 0), (2, [3.0, 2.0], 0), (2, [3.0, 2.0], 0), (None, [1.0, 2.0], 0)])).collect()
    assert {(r.vec_id, r.component, r.n, round(abs(r.whitened), 9)) for r in two} == {
        (1, 1, 2, 1.0), (2, 1, 2, 1.0), (None, 1, 2, 1.0)}
    assert len(two) == 4 and two[0].deviation == 2**18
    huge = whitening.whiten(make([(1, [1e30], 0), (2, [-1e30], 0), (3, [1.0], 0)])).collect()
    assert {r.deviation for r in huge if r.vec_id != 3} == {None} and len(huge) == 3


def brute_trie(rows, host=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            size = f"{len(role.encode()):016X}"
            convs[c].append((turn is not None, turn or 0, role, hashlib.sha256((size + role + text).encode()).digest(), text))
    convs = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, v in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(convs.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]) if host else tuple(v)
    members, children = defaultdict(list), defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        own = members[k]
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + (len(own) - 1) * (len(k[-1][1]) if k else 0)
        ends = ",".join(str(c) for c in sorted(c for c in own if len(built[c]) == len(k)))
        out.append((min(own), len(k), min(members[k[:-1]]) if k else None, len(own), len(children[k]), leaves[k],
                    saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def turns(spark, folder):
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    random = np.random.default_rng(9)
    odd = [(None, 0, "user", "no id"), (700, None, "user", "null turn"), (700, 0, None, None), (700, 0, "user", "tie"),
           (700, 0, "assistant", "tie"), (700, 1, "user", "same"), (700, 1, "user", "same"), (-5, 0, "user", "below"),
           (-105, 3, "user", "below"), (0, 0, "user", "zero"), (901, 0, "user", "gone"), (800, 0, "ab", "c"), (899, 0, "a", "bc")]
    # A large group of copies, chains that end within others, and a long conversation.
    copies = [(1000 + i, t, "user", f"copy {t}") for i in range(150) for t in range(7)]
    chains = [(2000 + i, t, "user", f"chain {t}") for i in range(30) for t in range(1 + i % 9)]
    branches = [(3000 + i, t, "user", f"b {int(random.integers(0, 2))}") for i in range(120) for t in range(9)]
    long_one = [(4000, t, "user", f"turn {t % 3}") for t in range(3000)] + [(4007, t, "user", f"turn {t % 3}") for t in range(2900)]
    return given.union(spark.createDataFrame(odd + copies + chains + branches + long_one, TURNS)).withColumns(
        {"depth": F.lit(1), "key": F.lit("k"), "part": F.lit("p"), "n_convs": F.lit(None)}).cache()


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_trie_is_brute_force(turns):
    got = prefix_trie.conversation_trie(turns)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert listed(got) == brute_trie(turns.select("conv_id", "turn", "role", "text").collect())


@pytest.mark.parametrize("ranges", [1, 2, 37])
def test_trie_for_any_ranges(turns, ranges):
    rows = turns.select("conv_id", "turn", "role", "text").filter("conv_id < 4000 or conv_id is null")
    convs = prefix_trie.conversations(rows)
    assert listed(prefix_trie.trie(convs, ranges)) == brute_trie(rows.collect(), host=False)


def test_trie_sql(spark, turns):
    rows = turns.select("conv_id", "turn", "role", "text").filter("conv_id < 4000 or conv_id is null")
    con = duckdb.connect()
    con.register("conversations", rows.toArrow())
    want = sorted(con.execute(prefix_trie.TRIE_SQL).fetchall(), key=str)
    assert listed(prefix_trie.conversation_trie(rows)) == want
    assert prefix_trie.conversation_trie(rows.limit(0)).count() == 0
    alone = prefix_trie.conversation_trie(spark.createDataFrame([(901, 0, "user", "gone")], TURNS)).collect()
    assert [(r.conv_id, r.depth, r.parent_conv_id, r.n_leaves) for r in alone if r.depth == 0] == [(901, 0, None, 1)]
