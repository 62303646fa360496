"""Discovery rates, comparisons, text jobs and file formats."""

import base64
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from specengine.functions import spectrum as SP
from specengine.operators import compare as CM
from specengine.operators import fdr as D
from specengine.operators import mapreduce as MR
from specengine.operators import text as X
from specengine.sinks import files as SF
from specengine.sinks import reports as R
from specengine.sources import spectra as SS
from specengine.sources import text as ST


def test_fdr_bin_ends(spark):
    scores = [0.0, 1e-8, 1e8, 1.7e308, 1.0]
    got = spark.createDataFrame([(s,) for s in scores], "s double").select(SP.fdr_bin(F.col("s"))).collect()
    assert [r[0] for r in got] == [0, 0, 3199, 3199, 1600]


def test_fdr_counts_above(spark):
    hits = spark.createDataFrame([(10.0, True), (11.0, False), (11.5, False)], "score double, is_decoy boolean")
    got = [tuple(r)[1:] for r in D.fdr_at_score(D.fdr_counts(hits)).orderBy("bin").collect()]
    assert got == [(2, 1, 1 / 3), (2, 0, 0.0), (1, 0, 0.0)]
    low = [tuple(r)[1:] for r in D.fdr_at_score(D.fdr_counts(hits), high_is_better=False).orderBy("bin").collect()]
    assert low == [(0, 1, 1.0), (1, 1, 0.5), (2, 1, 1 / 3)]


def test_empty_filters_keep_every_row(spark):
    df = spark.range(5)
    assert df.filter(D.and_filter([])).count() == 5
    assert df.filter(D.or_filter([])).count() == 5


def test_roc_points_of_nothing(spark):
    assert D.roc_points(spark.createDataFrame([], "q double")).count() == 0


def test_comparison_classes(spark):
    schema = "id long, charge int, rank int, peptide string, score double"
    a = [(1, 2, 1, "A", 100.0), (2, 2, 1, "A", 100.0), (3, 2, 1, "A", 100.0), (4, 2, 1, "A", 100.0), (5, 2, 1, "A", 100.0)]
    b = [(1, 2, 1, "A", 99.0), (2, 2, 1, "A", 60.0), (3, 2, 1, "B", 90.0), (3, 2, 2, "A", 80.0), (4, 2, 1, "B", 40.0)]
    a, b = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    got = {r.id: r["class"] for r in CM.compare_results(a, b).collect()}
    assert got == {1: "perfect", 2: "same_peptide", 3: "lower_rank", 4: "other_peptide", 5: "no_scan"}
    got = {r.id: r["class"] for r in CM.comparison_classes(a, b).collect()}
    assert got == {1: "equal", 2: "equal", 3: "close", 4: "a_much_better", 5: "only_a"}
    assert {r["class"] for r in CM.comparison_classes(b, a).collect() if r.id == 5} == {"only_b"}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_best_line_match_equals_brute_force(spark):
    lines = [("c", i, f"the {'quick brown fox lazy dog'[i % 9:]} {i % 4}") for i in range(0, 60)] + [("d", 0, "alone")]
    got = {(r.chapter, r.line_no): (r.best_line_no, r.similarity) for r in X.best_line_match(
        spark.createDataFrame(lines, "chapter string, line_no long, line string"), reach=7).collect()}
    for chapter, i, line in lines:
        near = [(j, other) for c, j, other in lines if c == chapter and j != i and abs(i - j) <= 7]
        if not near:
            assert (chapter, i) not in got
            continue
        scored = [((max(len(line), len(o)) - distance(line, o)) / max(len(line), len(o)), -j) for j, o in near]
        best = max(scored)
        assert got[(chapter, i)] == (-best[1], pytest.approx(best[0]))


def test_word_count_and_map_reduce_agree(spark):
    text = spark.createDataFrame([("Mary had a little lamb, a LAMB!",), ("  ",), ("Little Mary",)], "text string")

    def emit(batches):
        for b in batches:
            w = b["text"].str.upper().str.findall("[A-Z]+").explode().dropna().astype(str)
            yield pd.DataFrame({"word": w.to_numpy(), "n": 1})

    def total(key, batches):
        yield pd.DataFrame({"word": [key[0]], "n": [sum(int(b["n"].sum()) for b in batches)]})

    schema = "word string, n long"
    combine = lambda b: b.groupby("word", as_index=False)["n"].sum()
    a = {tuple(r) for r in X.word_count(text).collect()}
    assert a == {("MARY", 2), ("HAD", 1), ("A", 2), ("LITTLE", 2), ("LAMB", 2)}
    for combiner in (None, combine):
        got = MR.map_reduce(text, emit, schema, ["word"], total, schema, combiner)
        assert {tuple(r) for r in got.collect()} == a


# ---- files -------------------------------------------------------------------------------

def test_fasta(spark, tmp_path):
    path = tmp_path / "a.fasta"
    path.write_text(">sp|P1|X first\nMKWV\nTFIS*\n>empty\n>second one\nAAAA\n")
    got = [tuple(r) for r in ST.read_fasta(spark, str(path)).orderBy("annotation").collect()]
    assert got == [("second one", "AAAA", "SECOND"), ("sp|P1|X first", "MKWVTFIS", "P1")]
    assert ST.count_fasta(spark, str(path)).first()[0] == 3


def test_mgf(spark, tmp_path):
    path = tmp_path / "a.mgf"
    path.write_text("BEGIN IONS\nTITLE=one\nPEPMASS=500.5 1234.5\nCHARGE=2+\nRTINSECONDS=12.5\nSCANS=3\n"
                    "200.5\t3.0\n100.5 2.0\n300 0.0\nbad line here x\nEND IONS\n\n"
                    "BEGIN IONS\nTITLE=Plate: K, Spot_Id: 7341, Run: 12\nPEPMASS=400.25\n100 1\nEND IONS\n")
    rows = {r.id: r for r in SS.read_spectra(spark, str(path)).collect()}
    one, two = rows["one"], rows["7341"]
    assert tuple(one.precursor) == (500.5, 2, 1234.5) and one.rt_sec == 12.5
    assert [tuple(p) for p in one.peaks] == [(100.5, 2.0), (200.5, 3.0)]
    assert tuple(two.precursor) == (400.25, 1, None)
    path.write_text("BEGIN IONS\nTITLE=x\nWRONG=1\nEND IONS\n")
    with pytest.raises(Exception, match="unknown MGF line"):
        SS.read_mgf(spark, str(path)).collect()
    with pytest.raises(ValueError):
        SS.read_spectra(spark, "a.unknown")


def pack(values, kind, packed=False):
    raw = np.array(values, kind).tobytes()
    return base64.b64encode(zlib.compress(raw) if packed else raw).decode()


def test_mzxml_with_nested_scans(spark, tmp_path):
    scan = ('<scan num="{n}" msLevel="2" polarity="+" retentionTime="PT5.5S"><precursorMz precursorIntensity="7" '
            'precursorCharge="2" activationMethod="CID">400.5</precursorMz><peaks precision="{bits}" byteOrder="network" '
            'compressionType="{kind}" pairOrder="m/z-int">{data}</peaks></scan>')
    inner = scan.format(n=2, bits=32, kind="none", data=pack([200.5, 3.0, 100.5, 2.0], ">f4"))
    outer = scan.format(n=3, bits=64, kind="zlib", data=pack([300.25, 4.0], ">f8", True))
    survey = f'<scan num="1" msLevel="1"><peaks precision="32">{pack([1.0, 1.0], ">f4")}</peaks>{inner}</scan>'
    path = tmp_path / "a.mzxml"
    path.write_text(f"<mzXML><msRun>{survey}{outer}</msRun></mzXML>")
    rows = {r.id: r for r in SS.read_spectra(spark, str(path)).collect()}
    assert set(rows) == {"2", "3"}
    assert [tuple(p) for p in rows["2"].peaks] == [(100.5, 2.0), (200.5, 3.0)]
    assert [tuple(p) for p in rows["3"].peaks] == [(300.25, 4.0)]
    assert rows["2"].rt_sec == 5.5 and tuple(rows["2"].precursor) == (400.5, 2, 7.0)


def test_msp(spark, tmp_path):
    path = tmp_path / "a.msp"
    path.write_text('Name: AAAAEINVK/2\nMW: 887.5\nComment: Spec=Consensus Protein="tr|B9|X sugar" Pseq=1\n'
                    'Num peaks: 2\n408.0\t1579\t"y8"\n399.6\t1662\t"y8-17"\n\nName: CCCK/3\nMW: 900\nComment: Mods=0\n'
                    'Num peaks: 1\n100.0\t1\t"?"\n\n')
    rows = {r.peptide: r for r in SS.read_msp(spark, str(path)).collect()}
    assert rows["AAAAEINVK"].protein == "tr|B9|X" and rows["AAAAEINVK"].precursor.mz == 443.75
    assert [p.mz for p in rows["AAAAEINVK"].peaks] == [399.6, 408.0]
    assert [tuple(r) for r in SS.library_peptides(spark, str(path)).collect()] == [("AAAAEINVK", "tr|B9|X", 2)]


def test_dta_folder(spark, tmp_path):
    (tmp_path / "x.1.dta").write_text("1000.5 2\n100.5 3\n200.5 4\n")
    (tmp_path / "other.txt").write_text("no")
    row = SS.read_dta_dir(spark, str(tmp_path)).collect()
    assert len(row) == 1 and row[0].id == "x.1.dta"
    assert row[0].precursor.mz == pytest.approx((1000.5 - 1.007276) / 2 + 1.007276)
    assert len(row[0].peaks) == 2


def test_lines_keep_their_numbers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\nthree\n")
    got = [tuple(r) for r in ST.lines_from_files(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == [("a.txt", 0, "one"), ("a.txt", 2, "three")]


def test_library_lookup_reads_one_folder(spark, tmp_path):
    rows = [(f"PEP{i}", 900.0 + i / 3, 900.0 + i / 3) for i in range(900)]
    path = str(tmp_path / "db")
    SF.write_peptide_db(spark.createDataFrame(rows, "mod_sequence string, mass double, matching_mass double"), path)
    found = SF.peptides_of_mass(spark, path, 1000)
    assert {r.mod_sequence for r in found.collect()} == {"PEP300", "PEP301", "PEP302"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(mass_band" in plan and "PushedFilters: [IsNotNull(mass_int), EqualTo(mass_int,1000)]" in plan


def test_long_protein_lists_are_split_not_cut(spark):
    members = spark.createDataFrame([("PEP", f"P{i}") for i in range(95)], "peptide string, protein string")
    got = R.listed_proteins(members, per_line=10).collect()
    assert len(got) > 5
    assert sorted(p for r in got for p in r.proteins) == sorted(f"P{i}" for i in range(95))


def test_people_and_taxonomy(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Ann Lee,31\nBo Ray,9\n")
    assert ST.read_people(spark, str(tmp_path / "p.csv")).filter("age > 10").count() == 1
    (tmp_path / "t.xml").write_text('<bioml><taxon label="yeast"><file format="peptide" URL="y.fasta"/></taxon></bioml>')
    assert tuple(ST.read_taxonomy(spark, str(tmp_path / "t.xml")).first()) == ("yeast", "peptide", "y.fasta")


def test_a_hit_in_many_proteins_is_one_hit(spark, tmp_path):
    """2,500 proteins of one peptide: one spectrum_query, one search_hit, all names."""
    from specengine.sources import reports as RR

    row = (7, 2, 800.25, None, 1, "PEPK", 90.0, 40.0, 0.5, 3, 4, 7, 10.0, 20.0, 800.0)
    fields = ("id long, charge int, precursor_mass double, rt_sec double, rank int, peptide string, hyperscore double, "
              "next_hyperscore double, expect double, b_count int, y_count int, matched_peaks int, b_score double, "
              "y_score double, calc_mass double")
    second = (7, 2, 800.25, None, 2, "AEK[57.02]", 40.0, 0.0, 0.5, 3, 4, 7, 10.0, 20.0, 799.0)
    other = (8, 3, 500.0, 1.5, 1, "AEK[57.02]", 30.0, 0.0, 0.7, 1, 1, 2, 3.0, 4.0, 499.0)
    results = spark.createDataFrame([row, second, other], fields)
    members = spark.createDataFrame([("PEPK", f"P{i}") for i in range(2500)] + [("AEK[57.02]", 'Q<1>&"x"')],
                                    "peptide string, protein string")
    path = str(tmp_path / "pepxml")
    R.write_pepxml(results, members, path)
    hits = {(r.scan, r["rank"]): r for r in RR.read_pepxml_hits(spark, path).collect()}
    assert sorted(hits) == [("7", 1), ("7", 2), ("8", 1)]
    assert sorted(hits["7", 1].proteins) == sorted(f"P{i}" for i in range(2500))
    assert hits["8", 1].peptide == "AEK[57.02]" and hits["8", 1].is_modified
    assert hits["7", 2].proteins == ["Q<1>& x"] and hits["8", 1].rt_sec == 1.5
    text = "".join(f.read_text() for f in sorted((tmp_path / "pepxml").glob("part-*")))
    assert text.count("<spectrum_query") == 2 and text.count("<search_hit") == 3
    assert 'num_tot_proteins="2500"' in text and text.count("<alternative_protein") == 2499
    import xml.etree.ElementTree as ET
    for f in (tmp_path / "pepxml").glob("part-*"):
        assert ET.fromstring(f.read_text()).tag == "msms_run_summary"


def test_a_protein_is_one_line(spark, tmp_path):
    rows = [("A", f"PEP{i}") for i in range(2500)] + [("B", "PEP1"), ("C", "PEP2"), ("C", "PEP3")]
    hits = spark.createDataFrame([(p, q, 1, 0.0) for p, q in rows], "protein string, peptide string, scan int, rt_sec double")
    R.write_protein_tsv(hits, str(tmp_path / "tsv"))
    lines = [x.split("\t") for f in sorted((tmp_path / "tsv").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x[0] for x in lines] == ["A", "B", "C"]
    assert sorted((x[0], q) for x in lines for q in x[1:] if q) == sorted(rows)


def test_scans_nested_three_levels_deep(spark, tmp_path):
    def scan(num, level, inner="", peaks=True):
        listed = f'<peaks precision="32" byteOrder="network" pairOrder="m/z-int">{pack([100.0 + num, 5.0], ">f4")}</peaks>'
        return (f'<scan\n num="{num}" msLevel="{level}" retentionTime="PT{num}S">\n<scanOrigin parentFileID="x" num="9"/>'
                f'<precursorMz precursorIntensity="7.5" precursorCharge="2" activationMethod="CID">\n{500 + num}.25</precursorMz>'
                f'{listed if peaks else ""}{inner}</scan>')

    text = "<msRun>" + scan(1, 1, scan(2, 2, scan(3, 3, scan(4, 4)) + scan(5, 3)) + scan(6, 2), peaks=False) + scan(7, 1) + "</msRun>"
    path = tmp_path / "deep.mzxml"
    path.write_text(text)
    rows = {int(r.id): r for r in SS.read_mzxml(spark, str(path), None).collect()}
    assert sorted(rows) == [2, 3, 4, 5, 6, 7]
    for n, r in rows.items():
        assert r.precursor.mz == 500.25 + n and r.peaks[0].mz == 100.0 + n and r.rt_sec == float(n)
    assert {n: r.ms_level for n, r in rows.items()} == {2: 2, 3: 3, 4: 4, 5: 3, 6: 2, 7: 1}
    assert sorted(int(r.id) for r in SS.read_mzxml(spark, str(path), 3).collect()) == [3, 5]


def test_streamed_counts_survive_a_restart(spark, tmp_path):
    from specengine.streaming import words as SW

    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for lines in (["red blue", "red"], ["green red"], ["blue"]):
        spark.createDataFrame([(x,) for x in lines], "text string").coalesce(1).write.mode("append").parquet(source)
        running = SW.running_word_count(SW.stream_parquet(spark, source, "text string"), out, progress)
        running.processAllAvailable()
        running.stop()
    assert {r.word: r.n for r in SW.latest_counts(spark, out).collect()} == {"RED": 3, "BLUE": 2, "GREEN": 1}
    # A trigger writes what changed, not everything.
    last = spark.read.parquet(out).filter("trigger = 2").collect()
    assert [(r.word, r.n) for r in last] == [("BLUE", 2)]


def test_streamed_digest_is_the_digest(spark, tmp_path):
    from specengine.operators.digest import digest
    from specengine.streaming import words as SW

    rows = spark.createDataFrame([("A", "MKAAARGGGK"), ("B", "AAAKPGGRTT")], "protein string, sequence string")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = SW.stream_parquet(spark, str(tmp_path / "in"), rows.schema)
    running = SW.streaming_digest(stream, str(tmp_path / "out"), str(tmp_path / "progress"))
    running.processAllAvailable()
    running.stop()
    key = ["protein", "sequence"]
    got = spark.read.parquet(str(tmp_path / "out")).select(*key).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, digest(rows).select(*key).collect())) and got
