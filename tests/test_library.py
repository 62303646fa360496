"""Masses, digestion, modifications and the library against small Python loops."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from specengine.functions import masses as M
from specengine.functions import peptide as P
from specengine.operators import digest as D
from specengine.operators import library as L
from specengine.operators import mods as MO

PROTEINS = [
    ("A", "MKWVTFISLLFLFSSAYSRGVFRRDAHKSEVAHRFKDLGEENFKPALVLIAFAQYLQQCPFEDHVKLVNEVTEFAK"),
    ("B", "KPRPAAKKRAAAAK"),
    ("C", "GGGGGGGG"),
    ("D", "K"),
]
USABLE = re.compile("^[ACDEFGHIKLMNPQRSTVWY]{4,40}$")


def proteins(spark):
    return spark.createDataFrame(PROTEINS, "protein string, sequence string")


def pieces(sequence, after="KR", stop="P"):
    out, start = [], 0
    for i in range(len(sequence) - 1):
        if sequence[i] in after and sequence[i + 1] not in stop:
            out.append(sequence[start:i + 1])
            start = i + 1
    return [*out, sequence[start:]]


@pytest.mark.parametrize("sequence,mass", [
    ("EALNTTETSRECLKLAI", 1949.0009), ("CIITWAVDINLR", 1473.787692385), ("EKAAKMPIK", 1015.59630943),
    ("CIELSTMNLVRR", 1491.776), ("EATLCPVNGTSNTK", 1491.710), ("ECLKLAIKMCKP", 1490.788),
    ("QIIHGYIGLLNSY", 1490.799), ("EKLKFSSSS", 1012.53), ("QAVRLFKR", 1017.63), ("QERGSVVSR", 1017.54),
])
def test_golden_matching_masses(spark, sequence, mass):
    row = L.add_masses(spark.createDataFrame([(sequence,)], "sequence string")).first()
    assert row.matching_mass == pytest.approx(mass, abs=0.01)


def test_elements_and_formulas(spark):
    df = spark.createDataFrame([("H",), ("C6H12ON2",), ("C11H10ON2",)], "f string").select(
        M.formula_mass(F.col("f")).alias("mono"), M.formula_mass(F.col("f"), "average").alias("avg"))
    rows = df.collect()
    assert rows[0].mono == 1.007825035
    assert rows[0].avg == 1.00794
    assert rows[1].mono == pytest.approx(128.09496, abs=1e-4)
    assert rows[2].mono == pytest.approx(186.07931, abs=1e-4)


@pytest.mark.parametrize("rule,after,stop", [("trypsin", "KR", "P"), ("lysc", "K", ""), ("[DE]|{KP}", "DE", "KP")])
@pytest.mark.parametrize("missed", [0, 2])
def test_digest(spark, rule, after, stop, missed):
    want = []
    for name, sequence in PROTEINS:
        cut = pieces(sequence, after, stop)
        for i, k in itertools.product(range(len(cut)), range(missed + 1)):
            if i + k < len(cut):
                joined = "".join(cut[i:i + k + 1])
                start = sum(map(len, cut[:i]))
                if USABLE.match(joined):
                    before = sequence[start - 1] if start else "-"
                    end = start + len(joined)
                    want.append((name, joined, k, start, before, sequence[end] if end < len(sequence) else "-"))
    got = D.digest(proteins(spark), rule, missed, positions=True).select(
        "protein", "sequence", "missed_cleavages", "start", "before", "after").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_semi_cleavages(spark):
    want = set()
    for name, sequence in PROTEINS:
        for piece in pieces(sequence):
            ends = [piece] + [x for i in range(1, len(piece)) for x in (piece[:i], piece[i:])]
            want |= {(name, x) for x in ends if USABLE.match(x)}
    got = D.semi_cleavages(proteins(spark)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_count_missed(spark):
    df = spark.createDataFrame([("AKAKPRA",), ("KKK",), ("AAAA",), ("KP",)], "s string")
    assert [r[0] for r in df.select(D.count_missed(F.col("s"))).collect()] == [2, 2, 0, 0]


def test_number_of_variants(spark):
    df = spark.createDataFrame([("AMAMMK",), ("AAAAK",), ("QMAAK",)], "sequence string")
    got = MO.apply_mods(df, MO.parse_mods("15.9949@M"), 2, with_terminal=False).groupBy("sequence").count()
    assert {r.sequence: r["count"] for r in got.collect()} == {"AMAMMK": 1 + 3 + 3, "AAAAK": 1, "QMAAK": 2}
    ends = MO.apply_mods(df, [], 1).filter("sequence = 'QMAAK'").select("mod_sequence").collect()
    assert {r[0] for r in ends} == {"QMAAK", "Q[-17.027]MAAK"}


def test_fixed_mods_are_mandatory_on_demand(spark):
    df = spark.createDataFrame([("ASMK",)], "sequence string")
    mods = MO.parse_mods("79.966@S", fixed=True) + MO.parse_mods("15.9949@M")
    got = MO.apply_mods(df, mods, 1, with_terminal=False, fixed_mandatory=True)
    assert {r.mod_sequence for r in got.collect()} == {"AS[79.966]MK", "AS[79.966]M[15.995]K"}


def test_mod_strings_round_trip(spark):
    df = spark.createDataFrame([("n[42.011]SK[79.966]NVD",), ("PEPTIDE",)], "m string").select(
        P.plain_sequence(F.col("m")).alias("s"), P.parse_mod_sequence(F.col("m")).alias("mods"))
    first, second = df.collect()
    assert first.s == "SKNVD"
    assert [tuple(x) for x in first.mods] == [(1, "S", 42.011), (2, "K", 79.966)]
    assert second.s == "PEPTIDE" and second.mods == []


def test_mods_compatible_ignores_both_ends(spark):
    df = spark.createDataFrame([("MAAMAAM",)], "sequence string")
    mods = MO.parse_mods("15.9949@M")
    variants = MO.apply_mods(df, mods, 1, with_terminal=False)
    kept = lambda allowed: {r.mod_sequence for r in variants.filter(
        MO.mods_compatible(F.col("mods"), F.length("sequence"), allowed)).collect()}
    assert kept([]) == {"MAAMAAM"}
    assert kept([("S", "1")]) == {"MAAMAAM", "M[15.995]AAMAAM", "MAAMAAM[15.995]"}
    assert len(kept([("M", "15.995")])) == 4


def test_decoys_keep_their_mass(spark):
    peptides = MO.apply_mods(spark.createDataFrame([("AMDEK", "P1")], "sequence string, protein string"),
                             MO.parse_mods("15.9949@M"), 1, with_terminal=False)
    both = L.add_masses(L.reverse_decoys(peptides)).collect()
    targets = {r.nano for r in both if not r.is_decoy}
    decoys = [r for r in both if r.is_decoy]
    assert {r.nano for r in decoys} == targets
    assert {r.sequence for r in decoys} == {"KEDMA"}
    assert {m.pos for r in decoys for m in r.mods} == {4}
    assert {r.protein for r in decoys} == {"DECOY_P1"}


def test_dedupe_counts_proteins(spark):
    rows = [("AAAK", "P1", 0), ("AAAK", "P1", 0), ("AAAK", "P2", 0), ("CCCK", "P2", 0)]
    got = L.dedupe_peptides(spark.createDataFrame(rows, "sequence string, protein string, missed_cleavages int"))
    assert {r.sequence: (r.n_proteins, r.n_positions, r.first_protein) for r in got.collect()} == {
        "AAAK": (2, 3, "P1"), "CCCK": (1, 1, "P2")}


def test_labels(spark):
    df = spark.createDataFrame([("sp|P02769|ALBU",), ("gi-1 x",), ("REV1_YJL",)], "a string").select(
        P.protein_id(F.col("a")), P.decoy_label(F.col("a")), P.condition_protein_label(F.col("a")))
    assert [tuple(r) for r in df.collect()] == [
        ("P02769", None, "sp_P02769_ALBU"), ("GI_1", None, "gi-1 x"), ("REV1_YJL", "DECOY_YJL", "REV1_YJL")]
