"""Text files, FASTA, parameter files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specengine.functions.peptide import protein_id


def read_text_lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path)


def read_whole_files(spark: SparkSession, path) -> DataFrame:
    """(path, value) with one row per file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), "value")


def lines_from_files(spark: SparkSession, path) -> DataFrame:
    """chapter (file name), line_no (kept when blank lines are dropped), line."""
    files = read_whole_files(spark, path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("chapter"),
        F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"),
    ).filter(F.trim("line") != "")


def read_fasta(spark: SparkSession, path, partitions: int | None = None) -> DataFrame:
    """annotation, sequence, protein.

    Records are separated by a `>` at the start of a line, so one file is read
    by many tasks and a record never crosses two rows.  The first record keeps
    its own `>`; a trailing `*` and empty records are dropped.
    """
    records = spark.read.option("lineSep", "\n>").text(path)
    clean = records.select(F.regexp_replace("value", "^>|\\r", "").alias("r"))
    parts = clean.select(
        F.trim(F.regexp_extract("r", r"^([^\n]*)", 1)).alias("annotation"),
        F.regexp_replace(F.regexp_replace("r", r"^[^\n]*", ""), r"\s|\*\s*$", "").alias("sequence"),
    ).filter(F.col("sequence") != "")
    out = parts.withColumn("protein", protein_id(F.col("annotation")))
    return out.repartition(partitions) if partitions else out


def read_fasta_single(spark: SparkSession, path, partitions: int) -> DataFrame:
    """FASTA spread evenly over partitions, for a file with few but very long records."""
    return read_fasta(spark, path, partitions)


def count_fasta(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).filter(F.col("value").startswith(">")).agg(
        F.count(F.lit(1)).alias("n_proteins"))


def read_name_values(spark: SparkSession, path, comment: str = "#") -> DataFrame:
    """`name = value # comment` lines as (name, value)."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace(
        "value", f"{comment}.*$", "")).alias("l"))
    return lines.filter(F.col("l").rlike(r"^[^=\[]+=")).select(
        F.trim(F.regexp_extract("l", r"^([^=]+)=", 1)).alias("name"),
        F.trim(F.regexp_extract("l", r"^[^=]+=(.*)$", 1)).alias("value"))


def read_comet_params(spark: SparkSession, path) -> DataFrame:
    return read_name_values(spark, path)


def read_properties(spark: SparkSession, path) -> DataFrame:
    return read_name_values(spark, path)


def read_params(spark: SparkSession, path) -> DataFrame:
    """`<note type="input" label="...">value</note>` as (label, value)."""
    notes = spark.read.format("xml").option("rowTag", "note").schema(
        "_type string, _label string, _VALUE string").load(path)
    return notes.filter(F.col("_type") == "input").select(
        F.col("_label").alias("label"), F.trim("_VALUE").alias("value"))


def read_taxonomy(spark: SparkSession, path) -> DataFrame:
    """Taxon label, file format and URL of every file of a taxonomy."""
    taxa = spark.read.format("xml").option("rowTag", "taxon").schema(
        "_label string, file array<struct<_format:string,_URL:string>>").load(path)
    return taxa.select(F.col("_label").alias("taxon"), F.explode("file").alias("f")).select(
        "taxon", F.col("f._format").alias("format"), F.col("f._URL").alias("url"))


def read_people(spark: SparkSession, path) -> DataFrame:
    """`name,age` lines."""
    return spark.read.schema("name string, age int").option(
        "ignoreLeadingWhiteSpace", True).csv(path)


def extension(path: str) -> str:
    name = os.path.basename(path.rstrip("/")).lower()
    return name.removesuffix(".gz").rsplit(".", 1)[-1]
