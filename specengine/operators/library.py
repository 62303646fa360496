"""The peptide library: masses, decoys, one row per peptide, bins, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specengine.functions.arrays import once
from specengine.functions.masses import daltons, matching_nano, peptide_nano
from specengine.functions.peptide import DECOY, decoy_label, usable_peptide
from specengine.operators.digest import digest
from specengine.operators.mods import Modification, apply_mods, mods_nano
from specengine.operators.skew import salted_join, with_group_index, with_row_index
from specengine.session import store

BIN_WIDTH = 0.1
SECTION_ROWS = 10_000


def add_masses(peptides: DataFrame, mass_type: str = "mono", residues: str | None = None) -> DataFrame:
    """Exact `nano`, `mass` and `matching_mass`; modifications count when there are any.

    `residues` names a column with the exact mass of the residues, so that they
    are not added up again for every variant of a peptide; it is dropped.
    """
    nano = peptide_nano(F.col("sequence"), mass_type) if residues is None else F.col(residues)
    if "mods" in peptides.columns:
        nano = nano + mods_nano(F.col("mods"))
    peptides = peptides.withColumn("nano", nano)
    if residues not in (None, "nano"):
        peptides = peptides.drop(residues)
    return (
        peptides.withColumn("mass", daltons(F.col("nano")))
        .withColumn("matching_mass", daltons(matching_nano(F.col("nano"))))
    )


def reverse_protein_decoys(proteins: DataFrame) -> DataFrame:
    """Targets plus their reversed sequences; labels that are decoys already get no partner."""
    is_decoy = decoy_label(F.col("protein")).isNotNull()
    targets = proteins.withColumn("is_decoy", is_decoy)
    decoys = targets.filter(~F.col("is_decoy")).withColumn(
        "protein", F.concat(F.lit(DECOY), F.col("protein"))
    ).withColumn("sequence", F.reverse("sequence")).withColumn("is_decoy", F.lit(True))
    return targets.unionByName(decoys)


def reverse_decoys(peptides: DataFrame) -> DataFrame:
    """Targets plus reversed peptides; a modification moves with its residue."""
    decoys = peptides.withColumn("is_decoy", F.lit(True))
    if "mods" in peptides.columns:
        decoys = decoys.withColumn("mods", F.transform("mods", lambda m: m.withField(
            "pos", (F.length("sequence") + 1 - m.pos).cast("int"))))
    decoys = decoys.withColumn("sequence", F.reverse("sequence"))
    if "protein" in peptides.columns:
        decoys = decoys.withColumn("protein", F.concat(F.lit(DECOY), F.col("protein")))
    return peptides.withColumn("is_decoy", F.lit(False)).unionByName(decoys)


def dedupe_peptides(peptides: DataFrame, key: str = "sequence") -> DataFrame:
    """One row per peptide: protein and occurrence counts, first protein, validity.

    Counting runs in two steps, first per (peptide, protein), so a peptide that
    occurs everywhere is combined before it is shuffled and spread by protein.
    The proteins themselves stay rows (`peptide_proteins`): a list inside one
    row would have no size limit.
    """
    decoy = F.col("is_decoy") if "is_decoy" in peptides.columns else F.lit(False)
    per_protein = peptides.groupBy(key, "protein").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("missed_cleavages").alias("missed_cleavages"),
        F.bool_or(decoy).alias("d"),
        F.bool_or(~decoy).alias("t"),
    )
    return target_decoy_class(per_protein.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_proteins"),
        F.sum("n").alias("n_positions"),
        F.min("protein").alias("first_protein"),
        F.min("missed_cleavages").alias("missed_cleavages"),
        F.bool_or("d").alias("has_decoy"),
        F.bool_or("t").alias("has_target"),
    ))


def peptide_proteins(peptides: DataFrame, key: str = "sequence") -> DataFrame:
    """The union of proteins as rows: distinct (peptide, protein)."""
    return peptides.select(key, "protein").distinct()


def target_decoy_class(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "validity",
        F.when(F.col("has_target") & F.col("has_decoy"), "Real_and_Decoy")
        .when(F.col("has_target"), "Real")
        .when(F.col("has_decoy"), "Decoy")
        .otherwise("Unknown"),
    ).drop("has_target", "has_decoy")


def parser_counts(proteins: DataFrame, peptides: DataFrame) -> DataFrame:
    """name/value rows: proteins, decoys, residues, fragments, unique fragments."""
    p = proteins.agg(
        F.count(F.lit(1)).alias("proteins"),
        F.count_if(decoy_label(F.col("protein")).isNotNull()).alias("decoy_proteins"),
        F.coalesce(F.sum(F.length("sequence")), F.lit(0)).alias("amino_acids"),
    ).selectExpr("stack(3, 'proteins', proteins, 'decoy_proteins', decoy_proteins,"
                 " 'amino_acids', amino_acids) AS (name, value)")
    per = peptides.groupBy("sequence").agg(F.count(F.lit(1)).alias("n"))
    f = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("fragments"),
        F.count(F.lit(1)).alias("unique_fragments"),
    ).selectExpr("stack(2, 'fragments', fragments, 'unique_fragments', unique_fragments)"
                 " AS (name, value)")
    return p.unionByName(f)


def duplicate_histogram(peptides: DataFrame) -> DataFrame:
    """How many peptides occur in 1, 2, 3, ... proteins."""
    per = peptides.select("sequence", "protein").distinct().groupBy("sequence").agg(
        F.count(F.lit(1)).alias("n_proteins"))
    return per.groupBy("n_proteins").agg(F.count(F.lit(1)).alias("n_peptides"))


def mass_bin(nano, width: float = BIN_WIDTH):
    """Whole-number mass bin, from exact nano-Daltons."""
    return F.floor(nano / F.lit(round(width * 10**9)).cast("long")).cast("long")


def mass_to_bins(peptides: DataFrame, width: float = BIN_WIDTH, margin: float = 0.0) -> DataFrame:
    """One row per bin that the mass, give or take the margin, falls into."""
    step, m = round(width * 10**9), round(margin * 10**9)
    low = F.expr(f"div(nano - {m}L, {step}L)")
    high = F.expr(f"div(nano + {m}L, {step}L)")
    return peptides.withColumn("bin", F.explode(F.array_distinct(F.array(
        low, F.expr(f"div(nano, {step}L)"), high))))


def bin_counts(binned: DataFrame) -> DataFrame:
    modified = F.size("mods") > 0 if "mods" in binned.columns else F.lit(False)
    return binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n_peptides"),
        F.count_if(modified).alias("n_modified"),
    )


def bin_sections(binned: DataFrame, rows: int = SECTION_ROWS) -> DataFrame:
    """Cut each bin into sections of at most `rows` peptides, in sequence order."""
    key = "mod_sequence" if "mod_sequence" in binned.columns else "sequence"
    return with_group_index(binned, ["bin"], [key], "_at").withColumn(
        "section", F.floor(F.col("_at") / rows).cast("long")).drop("_at")


def db_sizes(peptides: DataFrame) -> DataFrame:
    """Peptides per whole-number matching mass."""
    return peptides.groupBy(F.col("matching_mass").cast("int").alias("mass_int")).agg(
        F.count(F.lit(1)).alias("n"))


def peptide_interval(peptides: DataFrame, start: int, end: int) -> DataFrame:
    """Rows [start, end) of every whole-number mass, in sequence order."""
    by_mass = peptides.withColumn("mass_int", F.col("matching_mass").cast("int"))
    return with_group_index(by_mass, ["mass_int"], ["sequence"], "_at").filter(
        (F.col("_at") >= start) & (F.col("_at") < end)).drop("_at")


def peptides_within(peptides: DataFrame, mass: float, below: float, above: float) -> DataFrame:
    """Peptides whose matching mass lies within a tolerance window."""
    return peptides.filter(F.col("matching_mass").between(mass - below, mass + above))


def fasta_statistics(proteins: DataFrame, rule: str = "trypsin") -> DataFrame:
    """Histograms of protein length, fragment length, and both fragment masses."""
    lengths = proteins.select(
        F.lit("protein_length").alias("what"),
        F.expr("div(length(sequence), 100) * 100").cast("long").alias("bin"),
    )
    whole = lambda kind: F.floor(
        peptide_nano(F.col("sequence"), kind) / 10**9).cast("long")
    fragments = digest(proteins, rule).select(
        F.explode(F.array(
            F.struct(F.lit("fragment_length").alias("what"),
                     F.length("sequence").cast("long").alias("bin")),
            F.struct(F.lit("mono_mass").alias("what"), whole("mono").alias("bin")),
            F.struct(F.lit("average_mass").alias("what"), whole("average").alias("bin")),
        )).alias("s")
    ).select("s.*")
    return lengths.unionByName(fragments).groupBy("what", "bin").agg(
        F.count(F.lit(1)).alias("n"))


def mass_index_table(peptides: DataFrame) -> DataFrame:
    """Distinct (whole mass, sequence, mass): the index table of the library."""
    return peptides.select(
        F.floor(F.col("nano") / 10**9).cast("int").alias("mass_int"), "sequence", "mass"
    ).distinct()


def annotation_ids(annotated: DataFrame, position: str = "pos") -> DataFrame:
    """Dense id from 1 per distinct annotation, in the order of first appearance."""
    firsts = annotated.groupBy("annotation").agg(F.min(position).alias("first_pos"))
    return with_row_index(firsts, ["first_pos", "annotation"], "id", start=1)


def sequence_seen(df: DataFrame, position: str = "pos") -> DataFrame:
    """Flag each row whose sequence occurred at an earlier position.

    Sequences are compared by their SHA-256, so a long text is not shuffled to
    be counted, and moves once, with its row.  The first position per sequence
    is a partially aggregated minimum, so a sequence that fills a third of the
    input is one row before the join, which cuts its rows into parts.
    """
    digest_of = F.sha2("sequence", 256)
    places = store(df.select(digest_of.alias("_digest"), F.col(position).alias("_pos")), "digests")
    firsts = places.groupBy("_digest").agg(F.min("_pos").alias("_first"))
    return salted_join(df.withColumn("_digest", digest_of), firsts, ["_digest"], sized_by=(places, firsts)).withColumn(
        "seen", F.col(position) > F.col("_first")).drop("_first", "_digest")


def build_library(proteins: DataFrame, rule: str = "trypsin", missed: int = 0,
                  mods: list[Modification] | None = None, max_mods: int = 2,
                  decoys: bool = False) -> DataFrame:
    """Proteins to the scored library: one row per modified peptide with exact masses.

    Duplicates are merged before variants are made, so the variants of a
    peptide are built once however many proteins hold it.
    """
    if decoys:
        proteins = reverse_protein_decoys(proteins)
    peptides = dedupe_peptides(digest(proteins, rule, missed))
    # What depends on the sequence alone is worked out before the variants are made.
    peptides = once(peptides.filter(usable_peptide(F.col("sequence"))), "_residues", peptide_nano(F.col("sequence")))
    if mods:
        peptides = apply_mods(peptides, mods, max_mods)
    else:
        peptides = peptides.withColumn("mod_sequence", F.col("sequence"))
    return add_masses(peptides, residues="_residues")
