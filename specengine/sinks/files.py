"""Library and spectrum files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specengine.operators.library import db_sizes

FASTA_WIDTH = 80
MASS_BAND = 100
MZ_BAND = 50


def write_fasta(proteins: DataFrame, path: str, width: int = FASTA_WIDTH) -> None:
    """`>annotation` and wrapped sequence lines."""
    wrapped = F.trim(F.regexp_replace("sequence", f"(.{{{width}}})", "$1\n"))
    proteins.select(F.concat(F.lit(">"), F.col("annotation"), F.lit("\n"), wrapped).alias(
        "value")).write.mode("overwrite").text(path)


def mgf_blocks(spectra: DataFrame) -> DataFrame:
    """One text value per spectrum in MGF layout."""
    charge = F.col("precursor.charge")
    peaks = F.array_join(F.transform("peaks", lambda p: F.format_string(
        "%.5f\t%.2f", p.mz, p.intensity.cast("double"))), "\n")
    return spectra.select(F.concat(
        F.lit("BEGIN IONS\nTITLE="), F.col("id").cast("string"),
        F.lit("\nPEPMASS="), F.col("precursor.mz").cast("string"),
        F.lit("\nCHARGE="), charge.cast("string"), F.when(charge > 0, "+").otherwise(""),
        F.lit("\n"), peaks, F.lit("\nEND IONS\n")).alias("value"))


def write_mgf(spectra: DataFrame, path: str, min_hyperscore: float | None = None) -> None:
    """Spectra, if asked only those whose `hyperscore` reaches the limit."""
    if min_hyperscore is not None:
        spectra = spectra.filter(F.col("hyperscore") >= min_hyperscore)
    mgf_blocks(spectra).write.mode("overwrite").text(path)


def write_mgf_expect(spectra: DataFrame, path: str, max_expect: float) -> None:
    """Spectra with an expectation value up to the limit, and not 0."""
    write_mgf(spectra.filter((F.col("expect") <= max_expect) & (F.col("expect") != 0)), path)


def with_mass_int(peptides: DataFrame, band: int) -> DataFrame:
    """Add the whole mass and the band of masses that is stored together."""
    mass_int = F.col("matching_mass").cast("int")
    return peptides.withColumn("mass_int", mass_int).withColumn(
        "mass_band", F.floor(F.col("mass_int") / band).cast("int"))


def write_peptide_db(peptides: DataFrame, path: str, mode: str = "overwrite",
                     band: int = MASS_BAND) -> None:
    """Parquet in folders of 100 Da, range-placed and sorted by mass.

    A lookup reads one folder, and the minimum and maximum of each row group
    skip what is not of that mass.  Rows are placed by (mass, sequence), so a
    crowded mass is written by several tasks, and a task writes to few folders.
    """
    order = ["mass_band", "mass_int", "mod_sequence"]
    with_mass_int(peptides, band).repartitionByRange(*order).sortWithinPartitions(
        *order).write.mode(mode).partitionBy("mass_band").parquet(path)


def guarantee_peptide_db(peptides: DataFrame, path: str) -> None:
    """Write the library only when there is none."""
    write_peptide_db(peptides, path, "ignore")


def read_peptide_db(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def peptides_of_mass(spark: SparkSession, path: str, mass_int: int,
                     band: int = MASS_BAND) -> DataFrame:
    """Library rows of one whole mass: one folder, and a pushed-down filter inside it."""
    return read_peptide_db(spark, path).filter(
        (F.col("mass_band") == mass_int // band) & (F.col("mass_int") == mass_int))


def write_peptides_by_mass(peptides: DataFrame, path: str, band: int = MASS_BAND) -> None:
    """CSV lines `sequence,mass,whole mass,first protein,proteins`; with band 1 a folder per mass."""
    order = ["mass_band", "mass_int", "mod_sequence"]
    with_mass_int(peptides, band).select(
        "mass_band", "mod_sequence", "mass", "mass_int", "first_protein", "n_proteins"
    ).repartitionByRange(*order).sortWithinPartitions(*order).write.mode(
        "overwrite").partitionBy("mass_band").csv(path)


def write_db_sizes(peptides: DataFrame, path: str) -> None:
    """Zero-padded mass, tab, number of peptides."""
    db_sizes(peptides).select(F.lpad(F.col("mass_int").cast("string"), 6, "0"), "n").write.mode(
        "overwrite").csv(path, sep="\t")


def read_db_sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("mass string, n long").csv(path, sep="\t").select(
        F.col("mass").cast("int").alias("mass_int"), "n")


def write_clusters_by_mz(clusters: DataFrame, path: str, band: int = MZ_BAND) -> None:
    """Clusters in folders of m/z bands, range-placed and sorted by precursor m/z."""
    order = ["mz_band", "precursor_mz", "cluster"]
    clusters.withColumn("mz_band", F.floor(F.col("mz_int") / band).cast("int")).repartitionByRange(
        *order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy(
        "mz_band").parquet(path)


def write_digester_params(spark: SparkSession, path: str, rule: str, missed: int, semi: bool,
                          decoys: bool, mods: list[str]) -> None:
    """The settings a library was built with, as a one-row JSON table next to it."""
    spark.createDataFrame(
        [(rule, missed, semi, decoys, sorted(mods))],
        "rule string, missed int, semi boolean, decoys boolean, mods array<string>",
    ).write.mode("overwrite").json(path)


def is_db_rebuild_required(spark: SparkSession, params_path: str, sizes_path: str, rule: str,
                           missed: int, semi: bool, decoys: bool, mods: list[str]) -> bool:
    """True when settings changed, or nothing is stored, or the stored library is empty."""
    try:
        stored = spark.read.schema(
            "rule string, missed int, semi boolean, decoys boolean, mods array<string>"
        ).json(params_path).first()
        empty = read_db_sizes(spark, sizes_path).isEmpty()
    except Exception as error:  # a path that does not exist
        if "PATH_NOT_FOUND" in str(error):
            return True
        raise
    wanted = (rule, missed, semi, decoys, sorted(mods))
    return empty or stored is None or (
        stored.rule, stored.missed, stored.semi, stored.decoys, sorted(stored.mods or [])) != wanted
