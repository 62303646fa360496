"""How the given tables stand in for proteins, spectra, hits and lines.

Whole tables and whole texts.  Values come from whole-number arithmetic with
one division at the end, so that any engine gets the same doubles.  `SQL`
holds the same definitions for the checking queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specengine.operators.condition import assemble_spectra
from specengine.session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def proteins(spark: SparkSession, folder: str) -> DataFrame:
    """(protein, sequence): the letters of a document that are residues."""
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return spread(table(spark, folder, "documents").select("doc_id", "text")).select(
        F.concat(F.lit("P"), F.col("doc_id").cast("string")).alias("protein"),
        F.regexp_replace(letters, "[BJOUXZ]", "").alias("sequence"))


def peak_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(id, mz10, mz, intensity): one peak per line item."""
    grid = (F.col("l_partkey") * 731 + F.col("l_suppkey") * 1370
            + F.col("l_linenumber").cast("long") * 10130) % 18000
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("id"), (F.lit(1500) + grid).alias("mz10"),
        F.col("l_quantity").alias("intensity"),
    ).withColumn("mz", F.col("mz10") / F.lit(10.0))


def precursors(spark: SparkSession, folder: str) -> DataFrame:
    """(id, precursor): one per order."""
    mz10 = F.lit(4000) + (F.col("o_orderkey") * 37) % 12000
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.struct((mz10 / F.lit(10.0)).alias("mz"),
                 (F.lit(1) + F.col("o_custkey") % 3).cast("int").alias("charge"),
                 F.lit(None).cast("double").alias("intensity")).alias("precursor"))


def spectra(spark: SparkSession, folder: str) -> DataFrame:
    return assemble_spectra(peak_rows(spark, folder), precursors(spark, folder))


def hits(spark: SparkSession, folder: str) -> DataFrame:
    """Search hits: an event is a scan with one scored match."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("scan"), F.col("value").alias("score"),
        (F.col("user_id") % 2 == 0).alias("is_decoy"),
        (F.col("event_type") == "error").alias("is_modified"),
        F.col("user_id").cast("string").alias("protein"),
        F.col("event_type").alias("peptide"), F.lit(1).alias("rank"))


def result_set(spark: SparkSession, folder: str, parity: int) -> DataFrame:
    """One of two result sets to be compared: events of one parity, scan = user."""
    return table(spark, folder, "events").filter(F.col("event_id") % 2 == parity).select(
        F.col("user_id").alias("id"), F.lit(2).alias("charge"), F.lit(1).alias("rank"),
        F.col("event_type").alias("peptide"), F.col("value").alias("score"))


def conversation_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("chapter"), F.col("turn").alias("line_no"),
        F.col("text").alias("line"))


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(chapter, line_no, line): the lines of every document, blank ones dropped."""
    return spread(table(spark, folder, "documents").select("doc_id", "text")).select(
        F.col("doc_id").cast("string").alias("chapter"),
        F.posexplode(F.split("text", "\n")).alias("line_no", "line"),
    ).filter(F.trim("line") != "").withColumn("line_no", F.col("line_no").cast("long"))


# The same definitions as CTEs.
SQL = {
    "proteins": """proteins AS (
  SELECT 'P' || CAST(doc_id AS VARCHAR) AS protein,
         regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[BJOUXZ]', '', 'g') AS sequence
  FROM documents)""",
    "pieces": """cut AS (
  SELECT protein, string_split(replace(replace(replace(replace(replace(replace(
    sequence, 'KP', '1'), 'RP', '2'), 'K', 'K|'), 'R', 'R|'), '1', 'KP'), '2', 'RP'), '|') AS parts
  FROM proteins),
pieces AS (
  SELECT protein, i, list_filter(parts, lambda x: x <> '') AS parts,
         list_filter(parts, lambda x: x <> '')[i] AS sequence
  FROM cut, unnest(range(1, len(list_filter(parts, lambda x: x <> '')) + 1)) AS u(i))""",
    "peptides": """peptides AS (
  SELECT protein, sequence FROM pieces
  WHERE regexp_matches(sequence, '^[ACDEFGHIKLMNPQRSTVWY]{4,40}$'))""",
    "peak_rows": """peak_rows AS (
  SELECT l_orderkey AS id, 1500 + (l_partkey * 731 + l_suppkey * 1370 + l_linenumber * 10130) % 18000 AS mz10,
         l_quantity AS intensity
  FROM lineitem),
peaks AS (
  SELECT id, mz10, mz10 / 10.0e0 AS mz, sum(intensity) AS intensity
  FROM peak_rows WHERE id IN (SELECT o_orderkey FROM orders) GROUP BY id, mz10)""",
    "precursors": """precursors AS (
  SELECT o_orderkey AS id, (4000 + (o_orderkey * 37) % 12000) / 10.0e0 AS pmz,
         CAST(1 + o_custkey % 3 AS INTEGER) AS z,
         ((4000 + (o_orderkey * 37) % 12000) / 10.0e0 - 1.007276e0) * CAST(1 + o_custkey % 3 AS INTEGER)
           + 1.007276e0 AS mass
  FROM orders)""",
    "hits": """hits AS (
  SELECT event_id AS scan, value AS score, user_id % 2 = 0 AS is_decoy,
         event_type = 'error' AS is_modified, CAST(user_id AS VARCHAR) AS protein,
         event_type AS peptide, 1 AS "rank"
  FROM events)""",
}


def ctes(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] if n in SQL else n for n in names) + "\n"


def residue_sql(expression: str, mass_type: str = "mono") -> str:
    """Exact nano-Daltons of a residue string in SQL: count of each letter times its mass."""
    from specengine.functions.masses import residue_table

    terms = [
        f"(length({expression}) - length(replace({expression}, '{aa}', ''))) * {nano}::BIGINT"
        for aa, nano in sorted(residue_table(mass_type).items()) if nano
    ]
    return "(" + " + ".join(terms) + ")"
