"""Numbering and joins that split hot keys must give what the plain forms give."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from specengine.operators import cluster as CL
from specengine.operators import filters as X
from specengine.operators import library as L
from specengine.operators import rangejoin as RJ
from specengine.operators import skew as SK
from specengine.operators import stats as ST

RNG = random.Random(3)


def skewed(spark, n, tag):
    rows = [(i, 0 if i % 3 == 0 else RNG.randint(1, 50), f"{tag}{i}") for i in range(n)]
    return rows, spark.createDataFrame(rows, f"{tag}_id long, key long, {tag} string")


def test_salted_join_equals_join(spark):
    _, left = skewed(spark, 300, "l")
    _, right = skewed(spark, 200, "r")
    plain = sorted(tuple(r) for r in left.join(right, "key").select("l_id", "r_id").collect())
    salted = sorted(tuple(r) for r in SK.salted_join(left, right, ["key"], 10).select("l_id", "r_id").collect())
    assert salted == plain
    hot = {r.key: r.parts for r in SK.hot_keys(left, ["key"], 10).collect()}
    assert hot[0] == 10


def test_a_key_is_cut_by_its_pairs(spark):
    crowd = spark.range(30_000).select(F.lit(7).cast("long").alias("key"), "id")
    some = spark.range(300).select((F.col("id") % 10 + 100).alias("key"), "id")
    parts = SK.key_parts(crowd.union(some), crowd.union(some), ["key"]).collect()
    assert [r.key for r in parts] == [7]
    assert math.ceil(30_000 / parts[0]["_a"]) * math.ceil(30_000 / parts[0]["_b"]) <= 5_000_000
    many = spark.range(70_000).select(F.lit(7).cast("long").alias("key"))
    few = spark.range(90).select(F.lit(7).cast("long").alias("key"))
    row = SK.key_parts(many, few, ["key"]).first()
    assert row["_a"] >= 3 and row["_b"] == 1 and math.ceil(70_000 / row["_a"]) * 90 <= 5_000_000
    # Pairs alone ask for a cut, though neither side has many rows.
    row = SK.key_parts(crowd.limit(2_500), crowd.limit(2_400), ["key"], pairs_per_task=100_000).first()
    assert math.ceil(2_500 / row["_a"]) * math.ceil(2_400 / row["_b"]) <= 100_000


def test_pairs_of_cut_keys_meet_once(spark):
    _, left = skewed(spark, 400, "l")
    _, right = skewed(spark, 300, "r")
    plain = sorted(tuple(r) for r in left.join(right, "key").select("l_id", "r_id").collect())
    cut = SK.salted_join(left, right, ["key"], 1000, pairs_per_task=500)
    assert sorted(tuple(r) for r in cut.select("l_id", "r_id").collect()) == plain


def test_row_index_is_dense_and_ordered(spark):
    rows = [(i, RNG.randint(0, 5)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(7)
    got = SK.with_row_index(df, ["v", "id"]).collect()
    assert [r.id for r in sorted(got, key=lambda r: r["index"])] == [i for i, _ in sorted(rows, key=lambda x: (x[1], x[0]))]
    assert sorted(r["index"] for r in got) == list(range(1000))


def test_folds_are_disjoint_and_complete(spark):
    df = spark.range(103).repartition(5)
    folds = [{r.id for r in X.nofk_filter(df, ["id"], 4, k).collect()} for k in range(4)]
    assert set().union(*folds) == set(range(103))
    assert sum(map(len, folds)) == 103


def test_bin_sections_hold_at_most_the_limit(spark):
    rows = [(0 if i % 3 == 0 else i % 20, f"S{i:05d}") for i in range(600)]
    got = L.bin_sections(spark.createDataFrame(rows, "bin long, sequence string"), 25).groupBy(
        "bin", "section").count().collect()
    assert max(r["count"] for r in got) <= 25
    assert sum(r["count"] for r in got) == 600


@pytest.mark.parametrize("width", [None, 0.2, 5.0])
def test_range_join_equals_brute_force(spark, width):
    left = [(i, round(RNG.uniform(0, 40), 2)) for i in range(150)]
    right = [(i, 20.0 if i % 3 == 0 else round(RNG.uniform(0, 40), 2)) for i in range(150)]
    want = sorted((a, b) for a, x in left for b, y in right if x - 0.6 <= y <= x + 1.1)
    got = RJ.range_join(spark.createDataFrame(left, "a long, x double"),
                        spark.createDataFrame(right, "b long, y double"),
                        "x", "y", 0.6, 1.1, width=width, rows_per_task=8).select("a", "b").collect()
    assert sorted(map(tuple, got)) == want


def test_group_values_keeps_everything(spark):
    rows = [(0 if i % 3 else 1, i % 40) for i in range(500)]
    got = ST.group_values(spark.createDataFrame(rows, "k long, v long"), "k", "v", chunk=7).collect()
    back = sorted((r.k, x.value) for r in got for x in r["values"] for _ in range(x.n))
    assert back == sorted(rows)
    assert len(got) > 2


def test_components_equal_union_find(spark):
    links = [(RNG.randint(0, 300), RNG.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(links, "id long, leader long")
    for most in (0, 100, 10_000):  # rounds to the end, rounds and one task, one task
        got = CL.connected_components(df, links_per_task=most).collect()
        assert {r.id: r.cluster for r in got} == {x: find(x) for x in list(root)}


def test_copies_cluster_and_strangers_do_not(spark):
    def spectrum(id_, mz, peaks):
        return (id_, (mz, 2, None), [(float(m), float(v)) for m, v in peaks])

    one, two = [(200, 9), (300, 50), (400, 70)], [(250, 40), (350, 60), (450, 80)]
    rows = [spectrum(i, 500.0 + i / 100, one) for i in range(40)]
    rows += [spectrum(100 + i, 500.0 + i / 100, two) for i in range(10)]
    rows += [spectrum(200 + i, 900.0, one) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, precursor struct<mz:double,charge:int,intensity:double>,"
                                     " peaks array<struct<mz:double,intensity:double>>")
    nodes, copies = CL.alike(CL.ranked_vectors(CL.bin_rows(df)), CL.MZ_WINDOW)
    assert nodes.count() == 3 and copies.count() == 55
    got = {r.id: r.cluster for r in CL.cluster_spectra(df).collect()}
    groups = [{got[r[0]] for r in rows if lo <= r[0] < lo + 100} for lo in (0, 100, 200)]
    assert [len(g) for g in groups] == [1, 1, 1]
    assert len(set().union(*groups)) == 3


def cluster_rows(kind, n, rng):
    """(id, m/z, {bin: intensity}) of spectra that crowd one group in different ways."""
    for i in range(n):
        mz = float(500 + rng.random() * 6)
        if kind == "shared peak":  # all hold one peak, and many are copies
            bins = [200, *rng.choice(np.arange(201, 215), 5, replace=False)] if i % 3 else range(200, 206)
            peaks = {int(x): float(rng.integers(1, 9)) if i % 3 else 1.0 for x in bins}
        elif kind == "near copies":
            peaks = {300 + x: 5.0 + float(rng.integers(0, 2)) for x in range(8)}
        elif kind == "chain":  # every spectrum is like its neighbours only
            mz, peaks = 700.0 + i * 0.7, {400 + i + x: 1.0 for x in range(4)}
        else:  # a peak that all have, below any use for the similarity
            peaks = {500: 6.0, **{1000 + 7 * i + x: 1.0 for x in range(6)}}
        yield i, mz, peaks


def brute_clusters(rows, majors):
    label = {r[0]: r[0] for r in rows}
    unit = {}
    for i, _, peaks in rows:
        w = {b: v**0.5 for b, v in peaks.items()}
        norm = sum(v * v for v in w.values()) ** 0.5
        largest = set(sorted(w, key=lambda b: (-w[b], b))[:majors])
        unit[i] = {b: v / norm for b, v in w.items()}, largest
    for a, mz_a, _ in rows:
        for b, mz_b, _ in rows:
            if a < b and abs(mz_a - mz_b) <= 1.0 and label[a] != label[b]:
                (x, major_x), (y, major_y) = unit[a], unit[b]
                dot = sum(w * y.get(k, 0.0) for k, w in x.items())
                if round(dot, 9) >= 0.6 and major_x & major_y:
                    low, high = sorted((label[a], label[b]))
                    label = {k: low if v == high else v for k, v in label.items()}
    return label


@pytest.mark.parametrize("kind", ["shared peak", "near copies", "chain"])
def test_clusters_are_those_of_brute_force(spark, kind, monkeypatch):
    rows = list(cluster_rows(kind, 120, np.random.default_rng(3)))
    df = spark.createDataFrame(
        [(i, (mz, 2, None), [(float(b), v) for b, v in p.items()]) for i, mz, p in rows],
        "id long, precursor struct<mz:double,charge:int,intensity:double>, peaks array<struct<mz:double,intensity:double>>")
    want = brute_clusters(rows, CL.MAJOR_PEAKS)
    assert 1 <= len(set(want.values())) < 150
    for parts in (8, 2_000):  # groups split into parts, and compared at once
        got = {r.id: r.cluster for r in CL.cluster_by_peak(df, rows_per_task=parts).collect()}
        assert got == want


def test_a_peak_that_all_have_makes_no_group(spark):
    rows = list(cluster_rows("common peak", 3000, np.random.default_rng(5)))
    df = spark.createDataFrame(
        [(i, (500.0, 2, None), [(float(b), v) for b, v in p.items()]) for i, _, p in rows],
        "id long, precursor struct<mz:double,charge:int,intensity:double>, peaks array<struct<mz:double,intensity:double>>")
    vectors = CL.ranked_vectors(CL.bin_rows(df))
    prefix = vectors.select(F.explode("prefix").alias("p")).select("p.key", "p.rest")
    # The common peak ends every prefix, with a norm whose square is below the similarity or just above it.
    shared = prefix.filter("key = 500").agg(F.max("rest")).first()[0]
    assert prefix.filter("key = 500").count() == 3000 and shared**2 == pytest.approx(0.5)
    nodes, _ = CL.alike(vectors, 1.0)
    assert CL.star_links(nodes, rows_per_task=500).count() == 0


def test_large_groups_equal_small_ones():
    rng = np.random.default_rng(8)
    n = 90
    rows = []
    for i in range(n):
        bins = np.sort(rng.choice(12, 5, replace=False))
        w = rng.random(5) + 0.1
        rows.append((bins, w / np.linalg.norm(w), rng.random(5) < 0.6, 500 + 3 * rng.random()))
    rows.sort(key=lambda r: r[3])
    bins, weights, major = (np.concatenate([r[k] for r in rows]) for k in range(3))
    lo = np.array([r[3] for r in rows])
    at, rest = np.arange(0, 5 * n + 1, 5), np.ones(n)
    many, few = np.arange(n), np.arange(n)
    CL._link_many(many, 0, n, lo, lo, rest, bins, weights, major, at, 1.0, 0.6)
    CL._link_few(few, np.arange(n), np.zeros(n, int), lo, lo, rest, bins, weights, major, at, 1.0, 0.6)
    assert (many == few).all() and 1 < len(set(many)) < n


def test_checkpoint_folder_is_the_session_setting(spark):
    from specengine.session import checkpoint_folder, scratch_path

    assert scratch_path(spark, "x").startswith(checkpoint_folder(spark).rstrip("/"))


class Unset:
    """A session as it is without `spark.checkpoint.dir`."""

    def __init__(self, spark, master):
        self.spark, self.conf, self.sparkContext, self.master = spark, self, self, master

    def get(self, key, default=None):
        return default if key == "spark.checkpoint.dir" else self.spark.conf.get(key, default)

    def set(self, key, value):
        self.spark.conf.set(key, value)


def test_checkpoint_folder_of_a_session_without_the_setting(spark):
    from specengine.session import OWN_FOLDER, checkpoint_folder

    folder = checkpoint_folder(Unset(spark, "local[4]"))
    assert os.path.isdir(folder) and checkpoint_folder(Unset(spark, "local[4]")) == folder
    spark.conf.unset(OWN_FOLDER)
    for master in ("spark://host:7077", "local-cluster[3,2,1024]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            checkpoint_folder(Unset(spark, master))


def test_select_proteins_containing(spark):
    proteins = spark.createDataFrame([("A", "MKWVTFISLL"), ("B", "GGGGGG"), ("C", "TFIS")], "protein string, sequence string")
    listed = spark.createDataFrame([("TFIS",), ("VTFISL",)], "sequence string")
    assert {r.protein for r in X.select_proteins_containing(proteins, listed).collect()} == {"A", "C"}
    assert X.select_proteins_containing(proteins, listed.limit(0)).count() == 0


def test_many_peptides_are_found_as_by_search(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ACDE") for _ in range(n))
    rows = [(f"P{i}", "AAAA" + word(60) if i % 4 else word(3)) for i in range(200)] + [("none", None), ("empty", "")]
    words = [word(rng.choice((1, 5, 6, 9))) for _ in range(40)] + [""]
    for listed in (words, [w for w in words if len(w) > 4]):
        want = {p for p, s in rows if s and any(w and w in s for w in listed)}
        proteins = spark.createDataFrame(rows, "protein string, sequence string").repartition(3)
        peptides = spark.createDataFrame([(w,) for w in listed], "sequence string")
        for shard in (7, 1000):  # several automata, and one
            got = X.select_proteins_containing(proteins, peptides, shard)
            assert {r.protein for r in got.collect()} == want and want
            assert got.columns == ["protein", "sequence"]


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(5000).withColumn("k", F.col("id") * 7)
    samples = [lambda d: X.percentile_filter(d, "k", 10, 30), lambda d: X.random_fraction(d, 0.2, ["k"]),
               lambda d: X.limit_rows(d, "k", 700)]
    for sample in samples:
        one, many = ({r.id for r in sample(df.repartition(n)).collect()} for n in (1, 50))
        assert one == many and 600 < len(one) < 1200
    assert {r.id for r in X.random_fraction(df, 0.2, ["k"], seed=1).collect()} != {
        r.id for r in X.random_fraction(df, 0.2, ["k"], seed=2).collect()}


def partition_rows(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_a_hot_group_is_numbered_over_many_tasks(spark):
    rows = [(0 if i % 3 == 0 else i % 50, i) for i in range(6000)]
    df = spark.createDataFrame(rows, "g long, v long").repartition(8)
    got = SK.with_group_index(df, ["g"], ["v"])
    seen, want = {}, {}
    for g, v in sorted(rows):
        want[g, v] = seen[g] = seen.get(g, -1) + 1
    assert {(r.g, r.v): r["index"] for r in got.collect()} == want


def test_rows_of_a_hot_key_get_their_side_row_in_parts(spark):
    hot = spark.range(90_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"), "id")
    side = hot.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = SK.salted_join(hot, side, ["key"], rows_per_task=2_000)
        sizes = partition_rows(joined)
        assert sum(sizes) == 90_000 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert joined.filter("key = 0").agg(F.min("n"), F.max("n")).first() == (30_000, 30_000)


def test_limit_rows(spark):
    df = spark.range(10_000)
    assert X.limit_rows(df, "id", None).count() == 10_000
    assert 800 < X.limit_rows(df, "id", 1000).count() < 1200
    assert F.col("id") is not None
