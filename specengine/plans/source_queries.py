"""Readers and writers: tables go to files of each format and are read back."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from specengine.operators import cluster as CL
from specengine.operators import condition as C
from specengine.operators import joins as J
from specengine.operators import psm as P
from specengine.operators.digest import digest
from specengine.operators.library import build_library, dedupe_peptides
from specengine.plans import search as Q
from specengine.plans.registry import query
from specengine.plans.score_queries import HISTOGRAM_SQL, KSCORE_SQL, states
from specengine.plans.spectrum_queries import SPECTRA_SQL
from specengine.plans.tables import ctes, hits, proteins, spectra, table
from specengine.session import scratch_path, spread, store
from specengine.sinks import files as S
from specengine.sinks import reports as R
from specengine.sources import reports as RR
from specengine.sources import spectra as SS
from specengine.sources import text as ST

# ---- FASTA -------------------------------------------------------------------------

FASTA_SQL = ctes("proteins") + """SELECT protein || ' whole text' AS annotation, md5(sequence) AS sequence_md5,
  CAST(length(sequence) AS INTEGER) AS n FROM proteins WHERE sequence <> ''"""


def fasta_file(spark, folder):
    path = scratch_path(spark, "fasta")
    S.write_fasta(proteins(spark, folder).filter("sequence <> ''").withColumn(
        "annotation", F.concat("protein", F.lit(" whole text"))), path)
    return path


def fasta_rows(df):
    return df.select("annotation", F.md5("sequence").alias("sequence_md5"), F.length("sequence").alias("n"))


@query("read_fasta", FASTA_SQL)
def read_fasta(spark, folder):
    return fasta_rows(ST.read_fasta(spark, fasta_file(spark, folder)))


@query("read_fasta_single", FASTA_SQL)
def read_fasta_single(spark, folder):
    return fasta_rows(ST.read_fasta_single(spark, fasta_file(spark, folder), 16))


@query("count_fasta", ctes("proteins") + "SELECT count(*) AS n_proteins FROM proteins WHERE sequence <> ''")
def count_fasta(spark, folder):
    return ST.count_fasta(spark, fasta_file(spark, folder))


# ---- spectra -----------------------------------------------------------------------

READ_SQL = SPECTRA_SQL + """SELECT CAST(id AS VARCHAR) AS id, pmz AS mz, z AS charge, CAST(len(peaks) AS INTEGER) AS n_peaks,
  list_sum(list_transform(peaks, lambda p: p.i)) AS intensity, round(peaks[1].mz, 3) AS first_mz FROM spectra"""


def read_back(df):
    return df.select(
        "id", F.col("precursor.mz").alias("mz"), F.col("precursor.charge").alias("charge"),
        F.size("peaks").alias("n_peaks"), C.spectrum_stats(F.col("peaks"))["sum_intensity"].alias("intensity"),
        F.round(F.get("peaks", F.lit(0)).mz, 3).alias("first_mz"))


@query("read_mgf", READ_SQL)
def read_mgf(spark, folder):
    path = scratch_path(spark, "mgf")
    S.write_mgf(spectra(spark, folder), path)
    return read_back(SS.read_mgf(spark, path))


@query("read_spectra", READ_SQL)
def read_spectra(spark, folder):
    path = scratch_path(spark, "spectra") + ".mgf"
    S.write_mgf(spectra(spark, folder), path)
    return read_back(SS.read_spectra(spark, path))


def scored(spark, folder):
    """Spectra with a score column for the writers that filter."""
    return spectra(spark, folder).withColumn("hyperscore", (F.col("id") % 100).cast("double")).withColumn(
        "expect", (F.col("id") % 7) / 1000.0)


@query("write_mgf", READ_SQL + " WHERE id % 100 >= 60")
def write_mgf(spark, folder):
    path = scratch_path(spark, "mgf")
    S.write_mgf(scored(spark, folder), path, 60.0)
    return read_back(SS.read_mgf(spark, path))


@query("write_mgf_expect", READ_SQL + " WHERE id % 7 / 1000.0e0 <= 0.003e0 AND id % 7 <> 0")
def write_mgf_expect(spark, folder):
    path = scratch_path(spark, "mgf")
    S.write_mgf_expect(scored(spark, folder), path, 0.003)
    return read_back(SS.read_mgf(spark, path))


def write_document(df, element, path, root):
    """Rows as XML documents, one per task; `element` makes their text, in the same Python step."""
    def wrap(batches):
        yield pd.DataFrame({"value": [f"<{root}>"]})
        yield from element(batches)
        yield pd.DataFrame({"value": [f"</{root}>"]})

    df.mapInPandas(wrap, "value string").write.text(path)


def _texts(batches):
    """Elements that are already text in the column `value`."""
    for batch in batches:
        yield batch[["value"]]


def _pack(values, kind, packed):
    raw = np.asarray(values).astype(kind).tobytes()
    return base64.b64encode(zlib.compress(raw) if packed else raw).decode()


def _mzxml(batches):
    for batch in batches:
        out = []
        for id_, p, peaks in zip(batch["id"], batch["precursor"], batch["peaks"]):
            flat = [v for x in peaks for v in (x["mz"], x["intensity"])]
            packed = id_ % 2 == 0
            out.append(
                f'<scan num="{id_}" msLevel="{1 + (id_ % 3 > 0)}" polarity="+" retentionTime="PT{id_}.5S">'
                f'<precursorMz precursorIntensity="1" precursorCharge="{p["charge"]}" activationMethod="CID">{p["mz"]}</precursorMz>'
                f'<peaks precision="32" byteOrder="network" compressionType="{"zlib" if packed else "none"}" '
                f'pairOrder="m/z-int">{_pack(flat, ">f4", packed)}</peaks></scan>')
        yield pd.DataFrame({"value": out})


def mzxml_file(spark, folder):
    path = scratch_path(spark, "scans") + ".mzxml"
    write_document(spectra(spark, folder), _mzxml, path, "msRun")
    return path


MZXML_SQL = READ_SQL + " WHERE id % 3 > 0"


@query("read_mzxml", MZXML_SQL)
def read_mzxml(spark, folder):
    return read_back(SS.read_mzxml(spark, mzxml_file(spark, folder)))


@query("combine_scans", MZXML_SQL.replace("SELECT CAST(id", "SELECT * FROM (SELECT CAST(id") + " ORDER BY spectra.id LIMIT 100)")
def combine_scans(spark, folder):
    path = mzxml_file(spark, folder)
    return read_back(SS.combine_scans(spark, [path], 100))


def _mzml(batches):
    cv = lambda a, v="": f'<cvParam cvRef="MS" accession="{a}" value="{v}"/>'
    for batch in batches:
        out = []
        for id_, p, peaks in zip(batch["id"], batch["precursor"], batch["peaks"]):
            packed = id_ % 2 == 0
            zip_ = cv("MS:1000574") if packed else cv("MS:1000576")
            mz = _pack([x["mz"] for x in peaks], "<f8", packed)
            intensity = _pack([x["intensity"] for x in peaks], "<f4", packed)
            out.append(
                f'<spectrum index="{id_}" id="controllerType=0 scan={id_}">{cv("MS:1000511", 2)}{cv("MS:1000130")}'
                f'<scanList><scan><cvParam cvRef="MS" accession="MS:1000016" value="2" unitAccession="UO:0000031"/></scan></scanList>'
                f'<precursorList><precursor><selectedIonList><selectedIon>{cv("MS:1000744", p["mz"])}'
                f'{cv("MS:1000041", p["charge"])}</selectedIon></selectedIonList><activation>{cv("MS:1000133")}</activation>'
                f'</precursor></precursorList><binaryDataArrayList>'
                f'<binaryDataArray>{cv("MS:1000523")}{zip_}{cv("MS:1000514")}<binary>{mz}</binary></binaryDataArray>'
                f'<binaryDataArray>{cv("MS:1000521")}{zip_}{cv("MS:1000515")}<binary>{intensity}</binary></binaryDataArray>'
                f'</binaryDataArrayList></spectrum>')
        yield pd.DataFrame({"value": out})


@query("read_mzml", READ_SQL)
def read_mzml(spark, folder):
    path = scratch_path(spark, "scans") + ".mzml"
    write_document(spectra(spark, folder), _mzml, path, "spectrumList")
    return read_back(SS.read_spectra(spark, path))


def msp_file(spark, folder):
    path = scratch_path(spark, "msp")
    peptides = dedupe_peptides(digest(proteins(spark, folder)))
    peaks = F.concat_ws("\n", *[F.concat(F.lit(f"{100 * i}.5\t"), (F.length("sequence") * i).cast("string"),
                                         F.lit('\t"b1"')) for i in (1, 2, 3)])
    peptides.select(F.concat(
        F.lit("Name: "), "sequence", F.lit("/"), (1 + F.length("sequence") % 3).cast("string"),
        F.lit("\nMW: 900.5\nComment: Spec=Consensus Mods=0 "),
        F.when(F.length("sequence") % 2 == 0, F.concat(F.lit('Protein="'), "first_protein", F.lit(' x" '))).otherwise(""),
        F.lit("Nreps=3\nNum peaks: 3\n"), peaks, F.lit("\n")).alias("value")).write.text(path)
    return path


LIB_SQL = ctes("proteins", "pieces", "peptides", """lib AS (
  SELECT sequence, min(protein) AS protein, CAST(1 + length(sequence) % 3 AS INTEGER) AS charge FROM peptides GROUP BY sequence)""")


@query("read_msp", LIB_SQL + """SELECT sequence AS peptide, charge, 900.5e0 / charge AS mz, CAST(3 AS INTEGER) AS n_peaks,
  CAST(length(sequence) * 6 AS DOUBLE) AS intensity FROM lib""")
def read_msp(spark, folder):
    return SS.read_msp(spark, msp_file(spark, folder)).select(
        "peptide", F.col("precursor.charge").alias("charge"), F.col("precursor.mz").alias("mz"),
        F.size("peaks").alias("n_peaks"), C.spectrum_stats(F.col("peaks"))["sum_intensity"].alias("intensity"))


@query("library_peptides", LIB_SQL + "SELECT sequence AS peptide, protein, charge FROM lib WHERE length(sequence) % 2 = 0")
def library_peptides(spark, folder):
    return SS.library_peptides(spark, msp_file(spark, folder))


@query("read_dta_dir", """SELECT s_suppkey, CAST(1 + s_nationkey % 3 AS INTEGER) AS charge, count(*) AS n_peaks, sum(q) AS intensity
FROM supplier JOIN (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def read_dta_dir(spark, folder):
    """One small file per supplier; its mass carries the supplier key."""
    path = scratch_path(spark, "dta")
    rows = table(spark, folder, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    peaks = rows.groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(
        " ", F.format_string("%.1f", F.col("l_partkey") + 0.5), F.col("q").cast("string")))), "\n").alias("p"))
    supplier = table(spark, folder, "supplier")
    supplier.join(peaks, supplier.s_suppkey == peaks.l_suppkey).select("s_suppkey", F.concat(
        F.format_string("%.3f", 1000.0 + F.col("s_suppkey")), F.lit(" "),
        (1 + F.col("s_nationkey") % 3).cast("string"), F.lit("\n"), "p").alias("value")).repartition(
        8, "s_suppkey").write.partitionBy("s_suppkey").text(path)
    back = SS.read_dta_dir(spark, path, "*.txt")
    proton = F.lit(1.007276)
    mass = (F.col("precursor.mz") - proton) * F.col("precursor.charge") + proton
    return back.select(
        F.round(mass - 1000.0).cast("long").alias("s_suppkey"), F.col("precursor.charge").alias("charge"),
        F.size("peaks").cast("long").alias("n_peaks"),
        C.spectrum_stats(F.col("peaks"))["sum_intensity"].alias("intensity"))


# ---- XML, parameters, plain text --------------------------------------------------------

@query("read_xml_tag", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def read_xml_tag(spark, folder):
    path = scratch_path(spark, "xml")
    table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal").write.format("xml").option(
        "rowTag", "customer").option("rootTag", "customers").save(path)
    return SS.read_xml_tag(spark, path, "customer", "c_custkey long, c_name string, c_acctbal double")


@query("read_params", "SELECT 'part, ' || p_partkey AS label, p_name AS value FROM part WHERE p_partkey % 3 <> 0")
def read_params(spark, folder):
    path = scratch_path(spark, "notes")
    kind = F.when(F.col("p_partkey") % 3 == 0, "heading").otherwise("input")
    write_document(table(spark, folder, "part").select(F.concat(
        F.lit('<note type="'), kind, F.lit('" label="part, '), F.col("p_partkey").cast("string"),
        F.lit('">'), "p_name", F.lit("</note>")).alias("value")), _texts, path, "bioml")
    return ST.read_params(spark, path)


NAMES_SQL = "SELECT 'part_' || p_partkey AS name, p_name AS value FROM part"


def name_value_file(spark, folder):
    path = scratch_path(spark, "params")
    table(spark, folder, "part").select(F.concat(
        F.lit("part_"), F.col("p_partkey").cast("string"), F.lit(" = "), "p_name",
        F.lit("   # "), "p_brand", F.lit("\n# only a comment")).alias("value")).write.text(path)
    return path


@query("read_comet_params", NAMES_SQL)
def read_comet_params(spark, folder):
    return ST.read_comet_params(spark, name_value_file(spark, folder))


@query("read_properties", NAMES_SQL)
def read_properties(spark, folder):
    return ST.read_properties(spark, name_value_file(spark, folder))


@query("read_taxonomy", "SELECT n_name AS taxon, 'peptide' AS format, 'file' || n_nationkey || '.fasta' AS url FROM nation")
def read_taxonomy(spark, folder):
    path = scratch_path(spark, "taxa")
    write_document(table(spark, folder, "nation").select(F.concat(
        F.lit('<taxon label="'), "n_name", F.lit('"><file format="peptide" URL="file'),
        F.col("n_nationkey").cast("string"), F.lit('.fasta"/></taxon>')).alias("value")), _texts, path, "bioml")
    return ST.read_taxonomy(spark, path)


@query("read_people", "SELECT c_name AS name, CAST(floor(c_acctbal) AS INTEGER) AS age FROM customer WHERE c_acctbal >= 0")
def read_people(spark, folder):
    path = scratch_path(spark, "people")
    table(spark, folder, "customer").filter("c_acctbal >= 0").select(
        "c_name", F.floor("c_acctbal").cast("int")).write.csv(path)
    return ST.read_people(spark, path)


def line_files(spark, folder):
    path = scratch_path(spark, "lines")
    spread(table(spark, folder, "documents").select("text")).select(
        F.regexp_replace("text", "\r", "").alias("value")).write.text(path)
    return path


@query("read_text_lines", """WITH l AS (SELECT unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line FROM documents)
SELECT md5(line) AS line_md5, count(*) AS n FROM l GROUP BY 1""")
def read_text_lines(spark, folder):
    return ST.read_text_lines(spark, line_files(spark, folder)).groupBy(
        F.md5("value").alias("line_md5")).agg(F.count(F.lit(1)).alias("n"))


@query("read_whole_files", """SELECT CAST(sum(length(replace(text, chr(13), '')) + 1) AS BIGINT) AS characters FROM documents""")
def read_whole_files(spark, folder):
    return ST.read_whole_files(spark, line_files(spark, folder)).agg(
        F.sum(F.length("value")).alias("characters"))


@query("lines_from_files", """WITH l AS (SELECT unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line FROM documents)
SELECT md5(line) AS line_md5, count(*) AS n FROM l WHERE trim(line) <> '' GROUP BY 1""")
def lines_from_files(spark, folder):
    return ST.lines_from_files(spark, line_files(spark, folder)).groupBy(
        F.md5("line").alias("line_md5")).agg(F.count(F.lit(1)).alias("n"))


# ---- reports -----------------------------------------------------------------------

def report(spark, folder):
    library = store(build_library(proteins(spark, folder)), "library")
    found = Q.search_report(spectra(spark, folder), library)
    members = digest(proteins(spark, folder)).select(F.col("sequence").alias("peptide"), "protein").distinct()
    results = R.ranked_report(found).withColumn("rt_sec", F.lit(0.0))
    return store(results, "results"), store(members, "members")  # both are read several times


REPORT_SQL = KSCORE_SQL + """
SELECT CAST(id AS VARCHAR) AS scan, charge, CAST(rank AS INTEGER) AS rank, peptide, hyperscore,
  (SELECT count(DISTINCT protein) FROM peptides q WHERE q.sequence = psm_ranked.peptide) AS n_proteins
FROM psm_ranked WHERE rank <= 8"""


@query("psm_report", KSCORE_SQL + """, counts AS (SELECT sequence, count(DISTINCT protein) AS n FROM peptides GROUP BY sequence),
r AS (SELECT p.*, coalesce(lead(hyperscore) OVER (PARTITION BY p.id ORDER BY rank), 0) AS next_hyperscore FROM psm_ranked p WHERE rank <= 8)
SELECT r.id, r.charge, CAST(r.rank AS INTEGER) AS rank, r.peptide, r.hyperscore, next_hyperscore, c.n AS n_proteins, round(s.mass - l.matching_mass, 6) AS massdiff
FROM r JOIN precursors s ON s.id = r.id JOIN lib l ON l.sequence = r.peptide JOIN counts c ON c.sequence = r.peptide""")
def psm_report(spark, folder):
    results, members = report(spark, folder)
    rows = R.psm_report(results, members)
    return rows.groupBy("id", "charge", "rank", "peptide", "hyperscore", "next_hyperscore", "massdiff").agg(
        F.sum(F.size("proteins")).alias("n_proteins")).withColumn("massdiff", F.round("massdiff", 6))


@query("read_pepxml_hits", KSCORE_SQL + """, firsts AS (SELECT sequence, min(protein) AS p, count(DISTINCT protein) AS n FROM peptides GROUP BY sequence)
SELECT CAST(id AS VARCHAR) AS scan, charge, CAST(rank AS INTEGER) AS rank, peptide, hyperscore, CAST(n AS INTEGER) AS n_proteins, false AS is_decoy
FROM psm_ranked JOIN firsts ON sequence = peptide WHERE rank <= 8""")
def read_pepxml_hits(spark, folder):
    path = scratch_path(spark, "pepxml")
    results, members = report(spark, folder)
    R.write_pepxml(results, members, path)
    return RR.read_pepxml_hits(spark, path).select(
        "scan", "charge", "rank", "peptide", "hyperscore", F.size("proteins").alias("n_proteins"), "is_decoy")


@query("bioml_report", KSCORE_SQL + """, firsts AS (SELECT sequence, min(protein) AS p FROM peptides GROUP BY sequence)
SELECT CAST(r.id AS VARCHAR) AS id, charge AS z, peptide, p AS protein, hyperscore, list_max(list_transform(s.peaks, lambda q: q.i)) AS max_intensity
FROM psm_ranked r JOIN firsts ON sequence = peptide JOIN spectra s ON s.id = r.id WHERE rank = 1""")
def bioml_report(spark, folder):
    """The BIOML report, written and read back."""
    path = scratch_path(spark, "bioml")
    results, members = report(spark, folder)
    stats = C.spectrum_stats(F.col("peaks"))
    R.write_bioml(R.bioml_report(results, members, spectra(spark, folder).select(
        "id", stats["log_sum"].alias("log_sum"), stats["max_intensity"].alias("max_intensity"))), path)
    return RR.read_bioml_report(spark, path).select(
        "id", "z", "peptide", "protein", "hyperscore", "max_intensity")


@query("report_per_input_file", KSCORE_SQL + """
SELECT 'file' || id % 4 AS input_file, count(*) AS n, min(id) AS least, max(id) AS greatest FROM psm_ranked WHERE rank = 1 GROUP BY 1""")
def report_per_input_file(spark, folder):
    path = scratch_path(spark, "reports")
    best = P.best_match(states(spark, folder, 1)).withColumn(
        "input_file", F.concat(F.lit("file"), (F.col("id") % 4).cast("string")))
    R.report_per_input_file(best, path)
    return spark.read.parquet(path).groupBy("input_file").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max("id").alias("greatest"))


def hit_rows(spark, folder):
    return hits(spark, folder).withColumn("rt_sec", F.col("score"))


@query("write_peptide_tsv", """SELECT event_type AS peptide, event_id AS scan, CAST(user_id AS VARCHAR) AS protein, value AS rt_sec FROM events""")
def write_peptide_tsv(spark, folder):
    path = scratch_path(spark, "peptides")
    R.write_peptide_tsv(hit_rows(spark, folder), path)
    return spark.read.schema("peptide string, scan long, protein string, rt_sec double").csv(path, sep="\t")


@query("write_protein_tsv", """SELECT DISTINCT CAST(user_id AS VARCHAR) AS protein, event_type AS peptide FROM events""")
def write_protein_tsv(spark, folder):
    path = scratch_path(spark, "proteins")
    R.write_protein_tsv(hit_rows(spark, folder), path)
    parts = F.split("value", "\t")
    return spark.read.text(path).select(parts[0].alias("protein"), F.explode(F.filter(F.slice(
        parts, F.lit(2), F.size(parts)), lambda p: p != "")).alias("peptide"))


@query("search_report", HISTOGRAM_SQL + """
SELECT r.id, CAST(r.rank AS INTEGER) AS rank, r.peptide, round(s.mass, 6) AS precursor_mass, l.matching_mass AS calc_mass
FROM psm_ranked r JOIN precursors s ON s.id = r.id JOIN lib l ON l.sequence = r.peptide WHERE rank <= 8""")
def search_report(spark, folder):
    library = build_library(proteins(spark, folder))
    return Q.search_report(spectra(spark, folder), library).select(
        "id", "rank", "peptide", F.round("precursor_mass", 6).alias("precursor_mass"), "calc_mass")


# ---- clustering ----------------------------------------------------------------------

@query("peak_keys", SPECTRA_SQL + """, w AS (SELECT id, floor(p.mz) AS bin, sqrt(sum(p.i)) AS w FROM (SELECT id, unnest(peaks) AS p FROM spectra) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, bin) AS r FROM w)
SELECT CAST(bin AS BIGINT) AS key, count(*) AS n FROM r WHERE r <= 6 GROUP BY 1""".replace("SELECT *,", "SELECT id, bin, w,"))
def peak_keys(spark, folder):
    return CL.peak_keys(CL.binned_vectors(spectra(spark, folder))).groupBy("key").agg(
        F.count(F.lit(1)).alias("n"))


def _pass_sql(step: str, window: float, majors: str) -> str:
    """One pass over rows_<step> (id, pmz, bin, w): links by similarity, components c_<step> (id, cluster)."""
    return f""",
unit_{step} AS (
  SELECT id, pmz, bin, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w,
         row_number() OVER (PARTITION BY id ORDER BY w DESC, bin) <= {majors} AS major FROM rows_{step}),
link_{step} AS (
  SELECT a.id AS x, b.id AS y FROM unit_{step} a JOIN unit_{step} b
  ON a.bin = b.bin AND a.id < b.id AND abs(a.pmz - b.pmz) <= {window}
  GROUP BY a.id, b.id HAVING round(sum(a.w * b.w), 9) >= {CL.SIMILARITY} AND bool_or(a.major AND b.major)),
both_{step} AS (SELECT x, y FROM link_{step} UNION ALL SELECT y, x FROM link_{step}),
c_{step}(id, cluster) USING KEY (id) AS (
  SELECT DISTINCT id, id AS cluster FROM rows_{step}
  UNION (SELECT e.y, min(c.cluster) FROM c_{step} c JOIN both_{step} e ON e.x = c.id
         JOIN recurring.c_{step} r ON r.id = e.y WHERE c.cluster < r.cluster GROUP BY e.y))"""


def _merge_sql(step: str, before: str, window: float) -> str:
    """Merge the clusters m_<before> (id, cluster) by their consensus into m_<step>, which keeps the centres' m/z."""
    return f""",
rows_{step} AS (
  SELECT m.cluster AS id, any_value(f.pmz) AS pmz, CAST(floor(p.mz) AS INTEGER) AS bin, sqrt(sum(p.intensity)) AS w
  FROM peaks p JOIN m_{before} m ON m.id = p.id
  JOIN (SELECT cluster, avg(s.pmz) AS pmz FROM m_{before} m JOIN precursors s ON s.id = m.id GROUP BY cluster) f
  ON f.cluster = m.cluster GROUP BY 1, 3)""" + _pass_sql(step, window, "1e9") + f""",
m_{step} AS (SELECT m.id, c.cluster FROM m_{before} m JOIN c_{step} c ON c.id = m.cluster)"""


BY_PEAK_SQL = ctes("peak_rows", "precursors").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""",
rows_1 AS (
  SELECT p.id, any_value(s.pmz) AS pmz, CAST(floor(mz) AS INTEGER) AS bin, sqrt(sum(intensity)) AS w
  FROM peaks p JOIN precursors s ON s.id = p.id WHERE s.pmz < {CL.MZ_LIMIT} GROUP BY p.id, 3)""" + _pass_sql(
    "1", CL.MZ_WINDOW, str(CL.MAJOR_PEAKS)) + """,
m_1 AS (SELECT id, cluster FROM c_1)"""
MERGE_SQL = BY_PEAK_SQL + _merge_sql("2", "1", CL.MZ_WINDOW / 4)


@query("cluster_by_peak", BY_PEAK_SQL + " SELECT id, cluster FROM m_1")
def cluster_by_peak(spark, folder):
    return CL.cluster_by_peak(spectra(spark, folder))


@query("merge_bins", MERGE_SQL + " SELECT id, cluster FROM m_2")
def merge_bins(spark, folder):
    scans = spectra(spark, folder)
    return CL.merge_bins(scans, CL.cluster_by_peak(scans), CL.MZ_WINDOW / 4)


@query("cluster_spectra", MERGE_SQL + _merge_sql("3", "2", CL.MZ_WINDOW) + """
SELECT cluster, count(*) AS n_members FROM m_3 GROUP BY cluster""")
def cluster_spectra(spark, folder):
    return CL.cluster_spectra(spectra(spark, folder)).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_members"))


@query("write_clusters_by_mz", BY_PEAK_SQL + f"""
SELECT cluster, count(*) AS n_members, round(avg(pmz), 6) AS precursor_mz, CAST(floor(avg(pmz)) AS INTEGER) AS mz_int,
       CAST(floor(floor(avg(pmz)) / {S.MZ_BAND}) AS INTEGER) AS mz_band, any_value(n) AS n_bins
FROM m_1 JOIN precursors s ON s.id = m_1.id JOIN (
  SELECT cluster AS c, count(DISTINCT floor(mz)) AS n FROM m_1 JOIN peaks p ON p.id = m_1.id GROUP BY cluster)
ON c = cluster GROUP BY cluster""")
def write_clusters_by_mz(spark, folder):
    """Every cluster as it is read back, with the band of m/z that its folder names."""
    path = scratch_path(spark, "clusters")
    scans = spectra(spark, folder)
    S.write_clusters_by_mz(CL.consolidate(scans, CL.cluster_by_peak(scans)), path)
    return spark.read.parquet(path).select(
        "cluster", "n_members", F.round("precursor_mz", 6).alias("precursor_mz"), "mz_int", "mz_band",
        F.size("bins").cast("long").alias("n_bins"))


@query("pre_flight", SPECTRA_SQL + "SELECT count(*) AS n FROM spectra WHERE z BETWEEN 1 AND 3")
def pre_flight(spark, folder):
    """Spectra that the bin join can use."""
    return spectra(spark, folder).filter(F.col("precursor.charge").isin(*J.CHARGES)).agg(
        F.count(F.lit(1)).alias("n"))
