"""Labels, selections and readers on cases that used to go wrong."""

from pyspark.sql import functions as F

from specengine.functions import peptide
from specengine.operators import filters
from specengine.sources import spectra, text


def one(spark, fn, value):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v"))).first()[0]


def test_labels(spark):
    assert one(spark, peptide.condition_protein_label, "a;b:c,d!e\"f|g'h\té") == "a b c d e f_g h"
    assert one(spark, peptide.protein_id, "-abc x") == "ABC"
    assert one(spark, peptide.protein_id, ">sp|Q1|Z rest") == "Q1"
    assert one(spark, peptide.protein_id, "a.b|é1") == "A_B_É1"
    assert one(spark, peptide.decoy_label, "REV_") is None
    assert one(spark, peptide.decoy_label, "REV_x") == "DECOY_x"


def test_selections_lose_nothing(spark):
    rows = spark.createDataFrame([("p1", "MKWVTF"), ("p2", "AAAAG"), ("p3", "MKAAA")], "protein string, sequence string")
    asked = spark.createDataFrame([("MKW",), ("AAAAG",), ("MKAAT",), ("",)], "sequence string")
    assert {r[0] for r in filters.select_proteins_containing(rows, asked).select("protein").collect()} == {"p1", "p2"}
    named = spark.createDataFrame([("ab 1", "x"), ("ab 1", "y"), ("abc", "z"), ("b", "w")], "annotation string, sequence string")
    ids = spark.createDataFrame([("a",), ("ab",), ("ab",), ("",), ("c" * 50,)], "prefix string")
    assert sorted(r[1] for r in filters.select_proteins_by_prefix(named, ids).select("annotation", "sequence").collect()) == ["x", "y", "z"]
    many = spark.createDataFrame([("q" * n,) for n in range(2, 1300, 7)] + [("ab",)], "prefix string")
    assert filters.select_proteins_by_prefix(named, many).count() == 3


def test_windows_line_ends(spark, tmp_path):
    (tmp_path / "a.fasta").write_bytes(b">P1 one\r\nMKV\r\nTF*\r\n>P2 two\r\nAAA\r\n")
    got = {r.annotation: r.sequence for r in text.read_fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert got == {"P1 one": "MKVTF", "P2 two": "AAA"}
    entry = "Name: {}/2\r\nMW: 500.5\r\nComment: Protein=\"Q\"\r\nNum peaks: 2\r\n100.5\t7\t\"b\"\r\n200.5\t9\t\"y\"\r\n \r\n"
    (tmp_path / "b.msp").write_bytes(("# made here\r\n" + entry.format("AAK") + entry.format("CCK")).encode())
    found = spectra.read_msp(spark, str(tmp_path / "b.msp")).collect()
    assert sorted((r.peptide, r.protein, len(r.peaks)) for r in found) == [("AAK", "Q", 2), ("CCK", "Q", 2)]


def test_case_variants_of_a_long_text_take_time_in_proportion(spark):
    import time
    from collections import Counter

    from specengine.operators import text as X
    letters = "".join(chr(97 + (i * i // 7) % 26) if i % 5 else "é" for i in range(400_000))
    frame = spark.createDataFrame([(letters.upper(),), ("a𝒳b",), ("ab",), (None,)], "text string")
    began = time.time()
    got = {r.variant: r.n for r in X.case_variant_count(frame).filter("variant = lower(variant)").collect()}
    assert time.time() - began < 40
    want = Counter(letters[i:i + 3] for i in range(len(letters) - 2))
    want["a𝒳b"] += 1  # a letter of two UTF-16 units, without a lower case
    assert {k: v for k, v in got.items() if k != "a𝒳b"} == {k: v for k, v in want.items() if k != "a𝒳b"} and "a𝒳b" in got
