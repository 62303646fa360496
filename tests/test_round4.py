"""Queries that failed by an error, a sum or a size, held against plain forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import compare
from specengine.functions import masses as M
from specengine.functions import text as T
from specengine.operators import blocks as B
from specengine.operators import condition as C
from specengine.operators import ions as I
from specengine.operators import joins as J
from specengine.operators import library as L
from specengine.operators import scoring as S
from specengine.operators import skew as SK
from specengine.operators import text as X
from specengine.operators.editdistance import PackedLines
from specengine.operators.mods import residue_masses
from specengine.plans import score_queries, tables
from specengine.plans import search as Q
from specengine.sinks import reports as R
from tests.test_queries import con  # noqa: F401
from tests.test_scores import ion_list, sequential_kscore


@pytest.mark.parametrize("name", ["read_params", "read_taxonomy"])
def test_documents_of_ready_text_are_written_and_read_back(spark, con, folder, name):  # noqa: F811
    status, note, _, _ = compare(spark, con, folder, name, entry.queries()[name], entry.oracle_sql()[name])
    assert status == "ok", note


def test_ion_use_moves_neither_ions_nor_dense_vectors(spark):
    rng = np.random.default_rng(8)
    letters = "ACDEFGHIKLMNPQRSTVWY"
    names = sorted({"".join(rng.choice(list(letters), rng.integers(1, 25))) for _ in range(60)})
    library = L.add_masses(spark.createDataFrame([(n,) for n in names], "sequence string")).withColumn("mod_sequence", F.col("sequence"))
    vectors, rows = {}, []
    for i in range(200):
        vector = np.zeros(int(rng.integers(1, 2600)))
        at = rng.integers(0, len(vector), len(vector) // 4)
        vector[at] = rng.integers(1, 99, len(at)) / 8
        vectors[i] = vector
        rows += [(i, int(rng.integers(1, 4)), str(p)) for p in rng.choice(names, 3, replace=False)]
    matches = spark.createDataFrame(rows, "id long, charge int, peptide string")
    dense = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "id long, vector array<double>")
    sparse = spark.createDataFrame([(i, np.flatnonzero(v).astype(float).tolist(), v[v > 0].tolist()) for i, v in vectors.items()],
                                   "id long, axis array<double>, value array<double>")
    used = S.ion_use(matches, sparse, library)
    plan = used._jdf.queryExecution().optimizedPlan().toString()
    assert "ions" not in plan and "vector" not in plan
    got = {(r.id, r.peptide): (r.b_score, r.y_score, r.b_count, r.y_count, r.matched_peaks) for r in used.collect()}
    assert got == {(r.id, r.peptide): (r.b_score, r.y_score, r.b_count, r.y_count, r.matched_peaks)
                   for r in S.ion_use(matches, dense, library).collect()}
    assert len(got) == len(rows)
    for id_, charge, peptide in rows:
        score, count = sequential_kscore(vectors[id_], ion_list(peptide, 1 if charge == 1 else 2))
        assert got[id_, peptide] == (pytest.approx(score["b"]), pytest.approx(score["y"]), count["b"], count["y"], count["b"] + count["y"])


def test_sparse_and_dense_vectors_are_the_same(spark, folder):
    scans = tables.spectra(spark, folder).limit(300)
    rows = C.k_vectors(C.condition_spectra(scans, C.Settings(isotope_mz=150.0))).collect()
    assert len(rows) > 20
    for r in rows:
        assert [(k, v) for k, v in enumerate(r.vector) if v != 0] == [(int(k), v) for k, v in zip(r.axis, r.value)]
        assert len(r.vector) == int(r.axis[-1]) + 1


BIG = [3 << 61, 3 << 61, 1 << 61, (1 << 20) - 1, -5]


def test_sums_of_masses_beyond_a_long_are_exact(spark, folder, monkeypatch):
    peptides = spark.createDataFrame([(v,) for v in BIG], "nano long")
    assert peptides.agg(M.nano_sum(F.col("nano"))).first()[0] == sum(BIG) >= 1 << 63
    monkeypatch.setattr(score_queries, "small_library", lambda *_: peptides)
    got = {r.type: int(r.nano) for r in score_queries.ion_types(spark, folder).collect()}
    assert got == {t: sum(BIG) + len(BIG) * sign * M.formula_nano(f) for t, _, _, f, sign in I.ION_TYPES}
    ions = peptides.select(F.lit(1).alias("z"), F.lit(2).alias("pos"), F.lit("b").alias("type"), "nano", F.lit(1.5).alias("mz"))
    monkeypatch.setattr(I, "theoretical_ions", lambda *_, **__: ions)
    assert score_queries.theoretical_ions(spark, folder).first().nano == sum(BIG)
    monkeypatch.setattr(I, "theoretical_ions", lambda *_, **__: ions.filter("nano < 1L << 60"))
    small = score_queries.theoretical_ions(spark, folder)
    assert small.first().nano == sum(BIG[3:]) and small.schema["nano"].dataType.simpleString() == "bigint"


def test_limit_sums_equal_the_pairs(spark):
    rng = np.random.default_rng(12)
    scans = []
    for i in range(400):
        z = int(rng.integers(0, 4))
        mass = float(rng.integers(300, 5200)) + float(rng.choice([0.0, 0.6, 0.5, 0.1, rng.random()]))
        scans.append((i, ((mass - 1.007276) / max(z, 1) + 1.007276, z, None)))
    scans.append((400, None))
    spectra = spark.createDataFrame(scans, "id long, precursor struct<mz:double,charge:int,intensity:double>")
    masses = [float(m) for m in range(280, 5300)] + [float(m) for m in np.round(rng.random(6000) * 5000 + 280, 4)]
    library = spark.createDataFrame([(f"P{i}", m, i * 10**9) for i, m in enumerate(masses)], "mod_sequence string, matching_mass double, nano long")
    pairs = Q.limits_join(spectra, library)
    want = {r.id: (r.n, r.nano) for r in pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("nano").alias("nano")).collect()}
    sums = Q.limits_join(spectra, library, sums="nano")
    assert {r.id: (r.n, r.nano) for r in sums.collect()} == want and len(want) > 380


def test_within_limits_makes_no_pairs(spark, folder):
    plan = score_queries.within_limits(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "mass_int" not in plan


def test_packed_distances_equal_the_table():
    rng = np.random.default_rng(3)
    make = lambda: "".join(rng.choice(list("abcdé ß😀"), rng.choice([0, 1, 7, 8, 9, 63, 64, 65, 130])))

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    packed, lines = PackedLines(), []
    for _ in range(60):
        line = make()
        if lines:
            assert packed.distances(line).tolist() == [table(line, other) for other in lines]
        packed.add(line)
        lines.append(line)
        if len(lines) > 12:
            packed.drop()
            lines.pop(0)


def test_best_lines_equal_all_pairs_and_blocks_hand_on_one_match_a_line(spark):
    rng = np.random.default_rng(21)
    rows = []
    for c in range(6):
        for n in sorted(rng.choice(90, 40, replace=False).tolist()) + [91, 91]:
            rows.append((f"c{c}", n, None if rng.random() < 0.03 else "".join(rng.choice(list("aBcÉ "), rng.integers(0, 30)))))
    lines = spark.createDataFrame(rows, "chapter string, line_no int, line string")
    a, b = lines.alias("a"), lines.alias("b")
    pairs = a.join(b, (F.col("a.chapter") == F.col("b.chapter")) & (F.col("a.line_no") != F.col("b.line_no"))
                   & (F.abs(F.col("a.line_no") - F.col("b.line_no")) <= 7))
    want = pairs.select("a.chapter", "a.line_no", F.struct(
        T.levenshtein_similarity(F.col("a.line"), F.col("b.line")).alias("s"), (-F.col("b.line_no")).alias("o")).alias("m")).groupBy(
        "chapter", "line_no").agg(F.max("m").alias("m")).select("chapter", "line_no", -F.col("m.o"), "m.s").collect()
    got = X.best_line_match(lines, 7)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want))) and len(want) > 200
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_crowded_bins_are_cut_so_that_few_rows_are_copied():
    n_left, n_right = np.zeros(100, int), np.zeros(100, int)
    n_left[50], n_right[50] = 30_000, 70_000
    plan = B.plan_blocks(n_left, n_right, 1.2)
    a, b = int(plan.left_parts[plan.block[50]]), int(plan.right_parts[plan.block[50]])
    assert 30_000 * 70_000 / (a * b) <= 5_000_000 and 30_000 / a <= B.ROWS_PER_BLOCK and 70_000 / b <= B.ROWS_PER_BLOCK
    assert 30_000 * b + 70_000 * a < 2_300_000  # cutting one side alone copies 12.7 million rows


def test_a_peptide_goes_to_its_blocks_by_its_letters(spark):
    mods = "array<struct<pos:int,nano:bigint>>"
    rows = [("PEPTIDEK", "PEPTIDEK", []), ("M[15.9949]KC", "MKC", [(1, 15_994_900_000), (3, 5)]), ("WxW", "WxW", None), ("ACD", "ACD", [(3, 7), (3, 8)])]
    library = spark.createDataFrame(rows, f"mod_sequence string, sequence string, mods {mods}")
    want = library.select(residue_masses(F.col("sequence"), F.col("mods")).alias("m")).collect()
    table = library.select("mod_sequence", F.when(F.col("sequence") != F.col("mod_sequence"), F.col("sequence")).alias("sequence"), "mods").toArrow()
    residues, at, letters = S._residues(table)
    assert letters.tobytes() == b"PEPTIDEKMKCWxWACD"
    assert [residues[a:b].tolist() for a, b in zip(at, at[1:])] == [[m or 0 for m in r.m] for r in want]
    scans = spark.createDataFrame([(1, (500.0, 1, None), [(200.0, 4.0), (300.0, 9.0)])],
                                  "id long, precursor struct<mz:double,charge:int,intensity:double>, peaks array<struct<mz:double,intensity:double>>")
    plan = S.score_spectra(scans, library.withColumn("matching_mass", F.lit(500.0)), J.BINS, "morpheus")
    assert "residues" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_a_join_without_hot_keys_is_a_plain_one(spark):
    left, right = spark.range(500).withColumn("l", F.col("id") * 2), spark.range(100).withColumn("r", F.col("id") * 3)
    joined = SK.salted_join(left, right, ["id"])
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "explode" not in plan and joined.columns == ["id", "l", "r"]
    assert sorted(joined.collect()) == sorted(left.join(right, "id").collect())


def test_report_pieces_count_the_proteins_once(spark, monkeypatch):
    made, counted = [], R.protein_counts
    monkeypatch.setattr(R, "protein_counts", lambda *args: made.append(1) or counted(*args))
    results = spark.createDataFrame([(1, 2, 500.0, 0.0, 1, "PEPK", 9.0, 3.0, 0.1, 4, 1.0, 2.0, 499.5)],
                                    "id long, charge int, precursor_mass double, rt_sec double, rank int, peptide string, hyperscore double, "
                                    "next_hyperscore double, expect double, matched_peaks int, b_score double, y_score double, calc_mass double")
    members = spark.createDataFrame([("PEPK", f"P{i}") for i in range(25)] + [("OTHER", "P1")], "peptide string, protein string")
    text = "".join(r.value for r in R.pepxml_pieces(results, members, 10).orderBy("id", "rank", "place", "part").collect())
    assert len(made) == 1 and text.count("<alternative_protein") == 24 and 'protein="P0" num_tot_proteins="25"' in text
    assert sum(len(r.proteins) for r in R.psm_report(results, members).collect()) == 25


def test_ions_of_many_peptides_equal_those_of_a_row(spark):
    rng = np.random.default_rng(31)
    rows = [("".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWYBX"), rng.integers(1, 30))), []) for _ in range(80)]
    rows += [("", []), (None, None), ("MKC", [(1, 15_994_900_000), (3, 5)]), ("P", []), ("AP", None)]
    peptides = spark.createDataFrame([(f"n{i}", *r) for i, r in enumerate(rows)], "mod_sequence string, sequence string, mods array<struct<pos:int,nano:bigint>>")
    plain = I.with_ions(peptides).select(F.col("mod_sequence").alias("peptide"), F.explode_outer("ions").alias("ion")).select("peptide", "ion.*")
    got = I.theoretical_ions(peptides)
    assert got.columns == plain.columns and got.dtypes == plain.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    # Beyond a letter that is no residue nothing is known.
    unknown = I.theoretical_ions(spark.createDataFrame([("PxK",)], "sequence string"), 1).collect()
    assert [(r.pos, r.type, r.nano is None) for r in unknown] == [(1, "b", False), (1, "y", True), (2, "b", True), (2, "y", True), (3, "b", True)]
    few = I.theoretical_ions(peptides, fields=("type", "weight"))
    assert few.columns == ["type", "weight"] and few.count() == plain.count()
    assert "flatten" not in few._jdf.queryExecution().optimizedPlan().toString()
