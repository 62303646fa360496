"""Steps whose cost grew faster than their input, held against the plain forms."""

import numpy as np
from pyspark.sql import functions as F

from specengine.functions.masses import residue_table
from specengine.operators import digest as D
from specengine.operators import joins as J
from specengine.operators import kernels as K
from specengine.operators import library as L
from specengine.operators import psm as P
from specengine.operators import scoring as S
from specengine.operators import windowsums
from specengine.plans import score_queries


def _sides(spark):
    scans = spark.range(1000).select("id", F.struct(
        (F.lit(400.0) + F.pmod(F.xxhash64("id"), F.lit(3000)) / 10.0).alias("mz"),
        F.when(F.col("id") % 7 == 0, 0).otherwise(1 + F.col("id") % 3).cast("int").alias("charge")).alias("precursor"))
    letters = F.array(*[F.lit(a) for a in "ACDEFGHIKLMNPQRSTVWY"])
    library = L.add_masses(spark.range(2000).select(F.array_join(F.transform(
        F.sequence(F.lit(0), F.lit(3) + F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(12)).cast("int")),
        lambda i: F.get(letters, F.pmod(F.xxhash64("id", i), F.lit(20)).cast("int"))), "").alias("sequence")).distinct())
    return scans, library.withColumn("mod_sequence", F.col("sequence"))


def _pair_sums(df):
    return {tuple(r) for r in df.groupBy("id").agg(F.count(F.lit(1)), F.sum("nano")).collect()}


def test_sums_of_window_joins_equal_those_of_the_pairs(spark):
    scans, library = _sides(spark)
    for join in (J.bin_charge_join, J.mass_limit_join, J.unknown_charge_join, J.da_tolerance_join):
        want = _pair_sums(join(scans, library))
        assert len(want) > 200
        assert {tuple(r) for r in join(scans, library, sums="nano").select("id", "n", "nano").collect()} == want


def test_window_sums_keep_the_exact_edges_and_cut_blocks(spark):
    masses = [499.4, 499.4, 499.39999, 500.0, 500.6, 500.60001]
    library = spark.createDataFrame([(f"P{i}", m, 1 << i) for i, m in enumerate(masses)], "mod_sequence string, matching_mass double, nano long")
    scans = spark.createDataFrame([(i, 500.0) for i in (1, 1, 2, 3)] + [(4, None), (5, 900.0)], "id long, precursor_mass double")
    window = 500.0 - 499.4
    keeps = lambda m, z, p: abs(p - m) <= window
    inside = [i for i, m in enumerate(masses) if abs(m - 500.0) <= window]
    for rows in (1, 2, 1000):
        got = {r.id: (r.n, r.nano) for r in windowsums.window_sums(
            scans, library, window, window, F.lit(1), keeps, "nano", rows=rows).collect()}
        each = (len(inside), sum(1 << i for i in inside))
        assert got == {1: (2 * each[0], 2 * each[1]), 2: each, 3: each}


def test_distinct_peptides_equal_plain_digest(spark, monkeypatch):
    given = [("a", "MKAAAAKAAAAKCCCCRPDDDDK"), ("b", "AAAAKAAAAK"), ("a", "AAAAKWWWW"), ("c", ""), ("d", None), ("e", "KKKKKK"),
             (None, "AAAAKGGGGGGG"), (None, "AAAAK"), ("f", "AAAAKGGGGGGGBGGGG" * 3)]
    proteins = spark.createDataFrame(given, "protein string, sequence string")

    for most in (1_000_000, 12):  # the second one takes long rows through the shuffle
        monkeypatch.setattr(D._distinct_peptides, "__defaults__", (most,))
        for missed in (0, 2):
            whole = D.digest(proteins, "trypsin", missed, usable=False).select("protein", "sequence").collect()
            usable = lambda x: 4 <= len(x) <= 40 and not set(x) & set("BZ")
            want = {(r[0], r[1]) for r in whole if usable(r[1])}
            got = [tuple(r) for r in D.missed_cleavages(proteins, missed).collect()]
            assert sorted(got, key=str) == sorted(want, key=str)
            ends = {(r[0], x) for r in whole for n in range(1, len(r[1]) + 1) for x in (r[1][:n], r[1][-n:]) if usable(x)}
            got = [tuple(r) for r in D.semi_cleavages(proteins, missed=missed).collect()]
            assert sorted(got, key=str) == sorted(ends, key=str)


def test_distinct_peptides_of_single_labels_are_not_shuffled(spark, tmp_path):
    spark.range(500).select(F.col("id").cast("string").alias("protein"), F.lit("AAAAKCCCCK" * 9).alias("sequence")).write.parquet(
        str(tmp_path / "p"))
    proteins = spark.read.parquet(str(tmp_path / "p"))
    for df in (D.missed_cleavages(proteins), D.semi_cleavages(proteins)):
        assert df.select("protein").distinct().count() == 500
        plan = df._jdf.queryExecution().executedPlan().toString().lower()
        assert plan.count("exchange") == plan.count("repartition_by_num") == 1  # the proteins' own


def test_seen_sequences_are_not_shuffled_as_keys(spark, tmp_path):
    given = [(7, "AB"), (3, "AB"), (5, "C"), (9, "AB"), (1, None), (None, "C"), (2, ""), (4, "")]
    spark.createDataFrame(given, "pos long, sequence string").write.parquet(str(tmp_path / "p"))
    df = L.sequence_seen(spark.read.parquet(str(tmp_path / "p")))
    assert set(df.columns) == {"sequence", "pos", "seen"}
    got = {(r.pos, r.sequence): r.seen for r in df.collect()}
    assert got == {(7, "AB"): True, (3, "AB"): False, (5, "C"): False, (9, "AB"): True, (None, "C"): None,
                   (2, ""): False, (4, ""): True}
    assert "hashpartitioning(sequence" not in df._jdf.queryExecution().executedPlan().toString()


def _block(rng, n):
    letters = [rng.choice(list(b"ACDEFGHIKLMNPQRSTVWY"), size=rng.integers(4, 30)) for _ in range(n)]
    at = np.append(0, np.cumsum([len(x) for x in letters]))
    letters = np.concatenate(letters).astype(np.uint8)
    masses = np.zeros(256, np.int64)
    for letter, nano in residue_table().items():
        masses[ord(letter)] = nano
    return K.Peptides(masses[letters], at, letters)


def test_credits_are_sorted_and_nothing_is_hashed(monkeypatch):
    def refused(*args, **kwargs):
        raise AssertionError("np.unique hashes whole numbers")

    peptides = _block(np.random.default_rng(7), 60)
    ions = peptides.ions(2)
    hits = [set() for _ in range(60)]
    for peptide, k in zip(ions.peptide.tolist(), K.k_index(ions.mz).tolist()):
        hits[peptide].add(k)
    monkeypatch.setattr(np, "unique", refused)
    at, index, share = K._credits(peptides, 2)
    for i, hit in enumerate(hits):
        want = {k: 1.0 for k in hit} | {k + d: 0.5 for k in hit for d in (1, -1) if k + d not in hit}
        own = slice(at[i], at[i + 1])
        assert index[own].tolist() == sorted(want) and dict(zip(index[own].tolist(), share[own].tolist())) == want
    for key in (np.array([5, 2, 5, 0]), np.array([-1, 7, -1]), np.array([1 << 61, 3, 1 << 61]), np.zeros(0, np.int64)):
        order = np.argsort(key, kind="stable")
        assert [x.tolist() for x in K.sorted_order(key)] == [key[order].tolist(), order.tolist()]
    assert K.distinct(np.zeros(0, np.int64)).tolist() == [] and K.distinct(np.array([3, 1, 3])).tolist() == [1, 3]


def test_blocks_are_not_merged_by_bytes(spark):
    scans, library = _sides(spark)
    vectors = scans.withColumn("precursor", F.col("precursor").withField("charge", F.lit(1))).withColumn(
        "peaks", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(
            (200.0 + 37 * i).alias("mz"), (50.0 + i).alias("intensity"))))
    plan = S.score_spectra(vectors, library, J.BINS, "morpheus")._jdf.queryExecution().executedPlan().toString()
    cut = [x for x in plan.splitlines() if "Exchange hashpartitioning(block" in x]
    assert len(cut) == 2 and all("REPARTITION_BY_NUM" in x for x in cut)


def _with_peaks(scans):
    return scans.withColumn("precursor", F.col("precursor").withField("charge", 1 + F.col("precursor.charge") % 2)).withColumn(
        "peaks", F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.struct(
            (150.0 + 17 * i + F.col("id") % 13).alias("mz"), (50.0 + i).alias("intensity"))))


def test_limits_and_totals_of_blocks_equal_those_of_the_pairs(spark):
    scans, library = _sides(spark)
    scans = _with_peaks(scans)
    pairs = S.score_spectra(scans, library, J.BINS, "tandem").collect()
    limit = sorted(p.hyperscore for p in pairs)[len(pairs) // 2]
    kept = S.score_spectra(scans, library, J.BINS, "tandem", above=limit).collect()
    assert sorted(kept) == sorted(p for p in pairs if p.hyperscore > limit) and len(kept) > 20
    of = {}
    for p in pairs:
        of.setdefault((p.algorithm, p.id, p.charge), []).append(p)
    got = {(t.algorithm, t.id, t.charge): t for t in S.score_totals(scans, library, J.BINS, "tandem").collect()}
    assert got.keys() == of.keys()
    for key, mine in of.items():
        t = got[key]
        assert (t.n, t.raw_best, t.best) == (len(mine), max(p.raw_score for p in mine), max(p.score for p in mine))
        assert abs(t.raw_total - sum(p.raw_score for p in mine)) < 1e-6


def test_states_serve_best_matches_and_histograms(spark):
    rows = [("k", i % 5, f"PEP{i % 90}", float(i * 37 % 400)) for i in range(600)]
    df = spark.createDataFrame(rows, "algorithm string, id long, peptide string, hyperscore double").distinct()
    states = P.spectrum_states(df, 2)
    same = lambda a, b, *c: sorted(a.select(*c).collect()) == sorted(b.select(*c).collect())
    assert same(P.best_match(states), P.best_match(df), "id", "peptide", "hyperscore")
    assert same(P.best_and_next(states), P.best_and_next(df), "id", "best_peptide", "next_peptide")
    assert same(P.hyperscore_histogram(states), P.hyperscore_histogram(df), "id", "bin", "n")


def test_pairs_are_scored_once_and_not_handed_on(spark, folder, monkeypatch):
    def refused(*args, **kwargs):
        raise AssertionError("all pairs are handed on")

    monkeypatch.setattr(S, "score_spectra", refused)
    made = []
    meet = S._meet
    monkeypatch.setattr(S, "_meet", lambda *args, **kwargs: made.append(1) or meet(*args, **kwargs))
    plan = score_queries.combine_scored_scans(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" not in plan
    score_queries.score_charges(spark, folder)
    assert len(made) == 2
