"""Steps whose memory or time grew faster than their input, held against plain forms."""

import base64

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from specengine.functions.masses import k_mass_index
from specengine.operators import cluster as CL
from specengine.operators import condition as C
from specengine.operators import library as L
from specengine.operators import mods as MO
from specengine.plans import source_queries
from specengine.sources import spectra as SS

PEAK = "array<struct<mz:double,intensity:double>>"
PRECURSOR = "struct<mz:double,charge:int,intensity:double>"


def _spectra(spark, rows):
    return spark.createDataFrame(rows, f"id long, precursor {PRECURSOR}, peaks {PEAK}")


def test_partitions_of_spectra_follow_the_peaks_and_grouping_by_id_stays_there(spark):
    peaks = spark.range(6000).select((F.col("id") % 700).alias("id"), (F.col("id") % 50).cast("double").alias("mz"),
                                     F.lit(2.0).alias("intensity"))
    precursors = spark.range(800).select("id", F.lit(1).alias("x"))
    spectra = C.assemble_spectra(peaks, precursors, peaks_per_task=100)
    weights = C.comet_bin_weights(C.explode_peaks(spectra))
    assert spectra.rdd.getNumPartitions() == weights.rdd.getNumPartitions() == 60
    assert spectra.count() == 700 and spectra.select(F.sum(F.expr("aggregate(peaks, 0D, (t, p) -> t + p.intensity)"))).first()[0] == 12_000


def test_k_normalisation_works_in_the_row_and_equals_plain_python(spark):
    rng = np.random.default_rng(5)
    rows = [(1, (500.0, 1, None), []), (2, None, [(200.0, 4.0)]), (3, (50.0, 1, None), [(400.0, 4.0)]), (4, (700.0, 2, None), [(300.25, 9.0)])]
    for i in range(5, 60):
        mz = np.sort(np.unique(rng.integers(1500, 15000, rng.integers(1, 200)) / 10))
        rows.append((i, (float(rng.integers(400, 900)), int(rng.integers(1, 4)), None),
                     [(float(m), float(v)) for m, v in zip(mz, rng.integers(0, 50, len(mz)))]))
    df = _spectra(spark, rows)
    result = C.k_sqrt_window_normalize(df)
    assert "Window" not in result._jdf.queryExecution().toString()
    got = {}
    for id_, k, mz, intensity in result.collect():
        got.setdefault(id_, {})[k] = (mz, intensity)
    index = {r[0]: r[1] for r in df.select(F.explode("peaks.mz").alias("m")).select("m", k_mass_index(F.col("m"))).collect()}
    for id_, precursor, peaks in rows:
        if not peaks or precursor is None:
            assert id_ not in got
            continue
        mz, z = precursor[0], precursor[1]
        mass = (mz - 1.007276) * z + 1.007276
        upper = int((mass + (z - 1) * 1.007276) / z * 2 + 0.5) + 10
        one = {}
        for m, v in peaks:
            low, s = one.get(index[m], (m, 0.0))
            one[index[m]] = (min(low, m), max(s, v ** 0.5))
        one = {k: v for k, v in one.items() if v[0] <= upper}
        if not one:
            assert id_ not in got
            continue
        span = 10 + int(max(m for m, _ in one.values()) - peaks[0][0])
        size = int(span / (10 if span > 3000 else 9 if span > 2500 else 8 if span > 2000 else 7 if span > 1500 else 6 if span > 1000 else 5))
        strongest = max(v for _, v in peaks) ** 0.5
        window = {k: (k - int(peaks[0][0] + 0.5)) // size for k in one}
        top = {w: max(one[k][1] for k in one if window[k] == w) for w in window.values()}
        scaled = {k: s * (strongest / top[window[k]]) if window[k] >= 0 and top[window[k]] > 0.05 * strongest else s
                  for k, (_, s) in one.items()}
        length = sum(s * s for s in scaled.values()) ** 0.5
        assert set(got[id_]) == set(one)
        for k, (m, v) in got[id_].items():
            assert m == one[k][0] and (length == 0 or abs(v - scaled[k] / length) < 1e-12)


def test_groups_without_shared_bins_list_no_pairs_and_link_as_brute_force():
    rng = np.random.default_rng(4)
    for trial in range(30):
        n = 200
        rows = []
        for g in range(2):
            for _ in range(n // 2):
                others = np.sort(rng.choice(np.arange(10, 60 if trial % 2 else 5000), 2, replace=False))
                w = rng.random(3) * [3, 1, 1] + 0.01
                start = 500 + 5 * rng.random()
                rows.append((g, start, start + rng.random(), np.concatenate(([g], others)), w / np.linalg.norm(w), rng.random(3) < 0.8))
        rows.sort(key=lambda r: (r[0], r[1]))
        group, lo, hi = (np.array([r[k] for r in rows]) for k in range(3))
        bins, weights, major = (np.concatenate([r[k] for r in rows]) for k in (3, 4, 5))
        at, leader = np.arange(0, 3 * n + 1, 3), np.arange(n)
        listed = []
        later = CL._later
        try:
            CL._later = lambda run: listed.append(later(run)) or listed[-1]
            left = CL._link_few(leader, np.arange(n), group, lo, hi, np.ones(n), bins, weights, major, at, 1.0, 0.6, group.astype(int), 200)
        finally:
            CL._later = later
        assert not len(left) and listed[0].sum() < (2000 if trial % 2 else 40)
        want = np.arange(n)
        for a in range(n):
            for b in range(a + 1, n):
                if group[a] != group[b] or lo[b] - hi[a] > 1.0:
                    continue
                shared = [(x, y) for x in range(3) for y in range(3) if rows[a][3][x] == rows[b][3][y]]
                product = sum(rows[a][4][x] * rows[b][4][y] for x, y in shared)
                if round(product, 9) >= 0.6 and any(rows[a][5][x] and rows[b][5][y] for x, y in shared):
                    want[want == max(want[a], want[b])] = min(want[a], want[b])
        assert (leader == want).all()


def _floats(values, kind):
    return base64.b64encode(np.asarray(values).astype(kind).tobytes()).decode()


def test_one_mzml_file_is_read_by_many_tasks(spark, tmp_path):
    cv = '<cvParam cvRef="MS" accession="{}" value="{}"/>'.format
    array = lambda values, name: f'<binaryDataArray>{cv("MS:1000523", "")}{cv(name, "")}<binary>{_floats(values, "<f8")}</binary></binaryDataArray>'
    spectra = [
        f'<spectrum index="{i}" id="scan={i}">{cv("MS:1000511", 1 + (i % 4 > 0))}<precursorList><precursor><selectedIonList><selectedIon>'
        f'{cv("MS:1000744", 400 + i)}{cv("MS:1000041", 2)}</selectedIon></selectedIonList></precursor></precursorList>\n<binaryDataArrayList>'
        f'{array([100.0, 200.0 + i], "MS:1000514")}{array([1.0, 2.0], "MS:1000515")}</binaryDataArrayList></spectrum>' for i in range(40)]
    path = tmp_path / "one.mzml"
    path.write_text('<?xml version="1.0"?><mzML><run><spectrumList count="40">\n' + "\n".join(spectra) + "</spectrumList></run></mzML>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = SS.read_mzml(spark, str(path))
        assert df.rdd.getNumPartitions() > 3
        got = {r.id: (r.precursor.mz, r.precursor.charge, [tuple(p) for p in r.peaks]) for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {str(i): (400.0 + i, 2, [(100.0, 1.0), (200.0 + i, 2.0)]) for i in range(40) if i % 4}


def test_first_scans_are_taken_before_any_is_decoded(spark, tmp_path):
    scan = '<scan num="{}" msLevel="2"><precursorMz precursorCharge="1">500.5</precursorMz><peaks precision="32">{}</peaks></scan>'.format
    good = _floats([100.0, 3.0], ">f4")
    path = tmp_path / "scans.mzxml"
    path.write_text("<msRun>" + scan(12, "AAA") + scan(9, good) + scan(1, good) + scan(10, good) + "</msRun>")
    df = SS.combine_scans(spark, [str(path)], 3)
    assert [(r.id, r.scan_number, len(r.peaks)) for r in df.collect()] == [("1", 1, 1), ("9", 9, 1), ("10", 10, 1)]
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().executedPlan().toString()


def test_documents_are_written_by_one_python_step(spark, tmp_path):
    def element(batches):
        for batch in batches:
            yield pd.DataFrame({"value": [f"<a>{i}</a>" for i in batch["id"]]})

    source_queries.write_document(spark.range(0, 6, 1, 2), element, str(tmp_path / "out"), "r")
    files = sorted(tuple(p.read_text().split()) for p in (tmp_path / "out").glob("part-*"))
    assert files == [("<r>", "<a>0</a>", "<a>1</a>", "<a>2</a>", "</r>"), ("<r>", "<a>3</a>", "<a>4</a>", "<a>5</a>", "</r>")]


def test_residues_are_added_up_once_for_a_peptide_not_for_its_variants(spark):
    proteins = spark.createDataFrame([("P1", "MMAYMKMEEYCMRMMMWYK"), ("P2", "QMYMK")], "protein string, sequence string")
    library = L.build_library(proteins, mods=MO.parse_mods("15.9949@M"))
    again = L.add_masses(library.select("sequence", "mods", F.col("nano").alias("want")))  # from the residues of every variant
    assert library.count() > 10 and again.filter("want <> nano").count() == 0 and "_residues" not in library.columns
    given = MO.apply_mods(proteins.select("sequence", F.lit(7).cast("long").alias("r")), MO.parse_mods("15.9949@M"), 1)
    got = L.add_masses(given, residues="r")
    assert got.filter(F.col("nano") != 7 + MO.mods_nano(F.col("mods"))).count() == 0 and "r" not in got.columns
