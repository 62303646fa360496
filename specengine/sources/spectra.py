"""Spectrum files as DataFrames.

Every reader gives id, label, scan_number, ms_level, polarity, rt_sec,
activation, precursor STRUCT<mz, charge, intensity> and peaks
ARRAY<STRUCT<mz, intensity>> sorted by m/z.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specengine.functions.arrays import once
from specengine.functions.spectrum import rt_seconds, scan_id_from_text
from specengine.operators.condition import PEAKS
from specengine.sources.text import extension

# MGF tags that are read over.
IGNORED_MGF_TAGS = ["TOLU", "TOL", "SEQ", "COMP", "TAG", "ETAG", "SCANS", "IT_MODS", "INSTRUMENT"]
KNOWN_MGF_TAGS = ["TITLE", "PEPMASS", "CHARGE", "RTINSECONDS"]

COLUMNS = ["id", "label", "scan_number", "ms_level", "polarity", "rt_sec", "activation",
           "precursor", "peaks"]


def _precursor(mz: Column, charge: Column, intensity: Column | None = None) -> Column:
    if intensity is None:
        intensity = F.lit(None)
    return F.struct(mz.cast("double").alias("mz"), charge.cast("int").alias("charge"),
                    intensity.cast("double").alias("intensity"))


def _complete(df: DataFrame) -> DataFrame:
    """All shared columns, NULL where a format does not have them."""
    types = {"id": "string", "label": "string", "scan_number": "int", "ms_level": "int",
             "polarity": "string", "rt_sec": "double", "activation": "string"}
    missing = {c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns}
    return df.withColumns(missing).select(*COLUMNS) if missing else df.select(*COLUMNS)


def _peak_lines(lines: Column, separator: str = r"[ \t]+") -> Column:
    """`mz intensity` lines to sorted peaks; other lines and intensities <= 0 are dropped."""
    parts = F.transform(lines, lambda x: F.split(F.trim(x), separator))
    peaks = F.transform(
        F.filter(parts, lambda p: F.size(p) >= 2),
        lambda p: F.struct(p[0].try_cast("double").alias("mz"),
                           p[1].try_cast("double").alias("intensity")))
    return F.array_sort(F.filter(peaks, lambda p: p.mz.isNotNull() & (p.intensity > 0))).cast(PEAKS)


def read_mgf(spark: SparkSession, path, strict: bool = True) -> DataFrame:
    """One row per BEGIN IONS .. END IONS block; the blocks split the file among tasks.

    The charge is 1 when it is not given.  With `strict`, a tag that is
    neither known nor listed as ignored raises an error.
    """
    blocks = spark.read.option("lineSep", "END IONS").text(path).filter(
        F.col("value").contains("BEGIN IONS"))
    body = F.regexp_replace("value", r"(?s)^.*BEGIN IONS", "")
    df = blocks.select(F.filter(F.transform(F.split(body, r"\r?\n"), lambda x: F.trim(x)),
                                lambda x: x != "").alias("lines"))
    tag = lambda name: F.regexp_replace(F.get(F.filter(
        "lines", lambda x: x.startswith(f"{name}=")), F.lit(0)), f"^{name}=", "")
    known = "|".join(KNOWN_MGF_TAGS + IGNORED_MGF_TAGS)
    if strict:
        unknown = F.get(F.filter("lines", lambda x: x.contains("=") & ~x.rlike(
            f"^({known})=")), F.lit(0))
        df = df.withColumn("lines", F.when(unknown.isNotNull(), F.raise_error(
            F.concat(F.lit("unknown MGF line: "), unknown)).cast("array<string>"))
            .otherwise(F.col("lines")))
    title = tag("TITLE")
    spot = F.regexp_extract(title, r",\s*Spot_Id: ([^,]*)", 1)
    mass = F.split(tag("PEPMASS"), r"[ \t]+")
    charge = F.coalesce(F.regexp_extract(tag("CHARGE"), r"(\d+)", 1).try_cast("int"), F.lit(1))
    out = df.select(
        F.when(spot != "", F.trim(spot)).otherwise(title).alias("id"),
        title.alias("label"),
        F.lit(2).alias("ms_level"),
        tag("RTINSECONDS").try_cast("double").alias("rt_sec"),
        F.lit("CID").alias("activation"),
        _precursor(F.get(mass, F.lit(0)).try_cast("double"), charge,
                   F.get(mass, F.lit(1)).try_cast("double")).alias("precursor"),
        _peak_lines(F.filter("lines", lambda x: ~x.contains("="))).alias("peaks"))
    return _complete(out)


def read_msp(spark: SparkSession, path) -> DataFrame:
    """Spectral library entries, each from its `Name:` line on: shared columns plus peptide, protein, mw.

    A file is split at these lines, whatever line ends and blank lines it has; what stands before the
    first one is no entry.
    """
    cut = spark.read.option("lineSep", "\nName:").text(path).select(F.replace("value", F.lit("\r"), F.lit("")).alias("v"))
    blocks = cut.select(F.when(F.col("v").startswith("Name:"), F.col("v")).otherwise(
        F.concat(F.lit("Name:"), F.col("v"))).alias("value")).filter(
        F.col("value").rlike(r"(?m)^(MW|Comment|Num peaks):"))
    field = lambda name: F.regexp_extract("value", rf"(?m)^{name}:\s*(.*)$", 1)
    name, comment = F.trim(field("Name")), field("Comment")
    mw = F.trim(field("MW")).try_cast("double")
    charge = F.regexp_extract(name, r"/(\d+)$", 1).try_cast("int")
    peaks = F.regexp_replace("value", r"(?s)^.*?Num peaks:[^\n]*\n?", "")
    df = blocks.select(
        name.alias("id"), name.alias("label"), F.lit(2).alias("ms_level"),
        F.lit("plus").alias("polarity"), F.lit("CID").alias("activation"),
        _precursor(mw / charge, charge).alias("precursor"),
        _peak_lines(F.split(peaks, r"\r?\n"), r"\t").alias("peaks"),
        F.regexp_replace(name, r"/\d+$", "").alias("peptide"),
        F.regexp_extract(comment, r'Protein="?([^" ]*)', 1).alias("protein"),
        mw.alias("mw"), comment.alias("comment"))
    return df.withColumns({
        "scan_number": F.lit(None).cast("int"), "rt_sec": F.lit(None).cast("double"),
    }).select(*COLUMNS, "peptide", "protein", "mw", "comment")


def library_peptides(spark: SparkSession, path) -> DataFrame:
    """(peptide, protein, charge) of the library entries that name a protein."""
    return read_msp(spark, path).filter(F.col("protein") != "").select(
        "peptide", "protein", F.col("precursor.charge").alias("charge"))


def read_dta_dir(spark: SparkSession, path, pattern: str = "*.dta") -> DataFrame:
    """A folder of .dta files: first line `mass charge`, then peaks; id is the file name."""
    files = spark.read.option("pathGlobFilter", pattern).option(
        "recursiveFileLookup", True).text(path, wholetext=True)
    df = files.select(
        F.element_at(F.split("_metadata.file_path", "/"), -1).alias("id"),
        F.split(F.trim("value"), r"\r?\n").alias("lines"))
    head = F.split(F.trim(F.get("lines", F.lit(0))), r"[ \t]+")
    mass, charge = head[0].try_cast("double"), head[1].try_cast("int")
    proton = F.lit(1.007276)
    return _complete(df.select(
        "id", F.col("id").alias("label"), F.lit(2).alias("ms_level"),
        _precursor((mass - proton) / F.greatest(charge, F.lit(1)) + proton, charge).alias("precursor"),
        _peak_lines(F.slice("lines", 2, 1_000_000_000)).alias("peaks")))


def read_xml_tag(spark: SparkSession, path, tag: str, schema: str | None = None) -> DataFrame:
    """One row per element of a name."""
    reader = spark.read.format("xml").option("rowTag", tag)
    return (reader.schema(schema) if schema else reader).load(path)


def _floats(text: str, bits: int, big_endian: bool, packed: bool) -> np.ndarray:
    import base64

    raw = base64.b64decode(text or "")
    if packed:
        raw = zlib.decompress(raw)
    return np.frombuffer(raw, f"{'>' if big_endian else '<'}f{bits // 8}").astype("float64")


def _decode_pairs(batches):
    """mzXML: interleaved m/z and intensity, big-endian."""
    for batch in batches:
        peaks = []
        for text, bits, packed in zip(batch["_text"], batch["_bits"], batch["_packed"]):
            v = _floats(text, int(bits), True, bool(packed))
            peaks.append([{"mz": m, "intensity": i} for m, i in zip(v[::2], v[1::2]) if i > 0])
        yield batch.drop(columns=["_text", "_bits", "_packed"]).assign(peaks=pd.Series(
            peaks, index=batch.index))


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in the text of a start tag, NULL without it."""
    found = F.regexp_extract(tag, rf"(?:^|\s){name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    return F.when(F.regexp_like(tag, F.lit(rf"(?:^|\s){name}\s*=")), found)


def read_mzxml(spark: SparkSession, path, ms_level: int | None = 2, first: int | None = None) -> DataFrame:
    """Scans of mzXML files, however deep they are nested in other scans; survey scans are dropped first.

    `first` asks for the first scans by number only; the others are not decoded.

    Files are cut behind each list of peaks, in parallel within a file.  What
    lies before a list holds the start of its scan, as the last start of a scan
    there, whether the scans around it are closed or not.
    """
    pieces = spark.read.option("lineSep", "</peaks>").text(path)
    start = F.regexp_extract("value", r"(?s)^.*<scan\s([^>]*)>", 1)
    body = F.regexp_extract("value", r"(?s)^.*<scan\s[^>]*>(.*)$", 1)
    scans = pieces.filter(F.regexp_like("value", F.lit(r"<scan\s"))).select(start.alias("_tag"), body.alias("_body")).filter(
        F.regexp_like("_body", F.lit(r"<peaks[\s>]")))
    if ms_level is not None:
        scans = scans.filter(_attribute(F.col("_tag"), "msLevel").try_cast("int") == ms_level)
    number = _attribute(F.col("_tag"), "num")
    if first is not None:
        # The generated column keeps the extractions below behind the limit, which is a top-k then and no sort of all scans.
        scans = once(scans.orderBy(number.try_cast("int"), number).limit(first), "_body", F.col("_body"))
    parent, peaks = (F.regexp_extract("_body", rf"(?s)<{n}\b([^>]*)>", 1) for n in ("precursorMz", "peaks"))
    whole = scans.withColumn("_parent", parent).withColumn("_list", peaks)
    flat = whole.select(
        number.alias("id"), number.alias("label"), number.try_cast("int").alias("scan_number"),
        _attribute(F.col("_tag"), "msLevel").try_cast("int").alias("ms_level"),
        F.when(_attribute(F.col("_tag"), "polarity") == "-", "minus").otherwise("plus").alias("polarity"),
        rt_seconds(_attribute(F.col("_tag"), "retentionTime")).alias("rt_sec"),
        _attribute(F.col("_parent"), "activationMethod").alias("activation"),
        F.regexp_extract("_body", r"(?s)<precursorMz\b[^>]*>\s*([^<\s]*)", 1).try_cast("double").alias("_mz"),
        F.coalesce(_attribute(F.col("_parent"), "precursorCharge").try_cast("int"), F.lit(0)).alias("_z"),
        _attribute(F.col("_parent"), "precursorIntensity").try_cast("double").alias("_i"),
        F.regexp_replace(F.regexp_extract("_body", r"(?s)<peaks\b[^>]*>(.*)$", 1), r"\s", "").alias("_text"),
        F.coalesce(_attribute(F.col("_list"), "precision").try_cast("int"), F.lit(32)).alias("_bits"),
        (F.coalesce(_attribute(F.col("_list"), "compressionType"), F.lit("none")) == "zlib").alias("_packed"))
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in flat.schema.fields
            if f.name not in ("_text", "_bits", "_packed")]
    decoded = flat.mapInPandas(_decode_pairs, ", ".join([*kept, f"peaks {PEAKS}"]))
    return _complete(decoded.withColumn("precursor", _precursor(
        F.col("_mz"), F.col("_z"), F.col("_i"))).withColumn("peaks", F.array_sort("peaks")))


# Accession numbers of the values read from mzML.
MS_LEVEL, SELECTED_MZ, CHARGE_STATE, PEAK_INTENSITY = (
    "MS:1000511", "MS:1000744", "MS:1000041", "MS:1000042")
OLD_SELECTED_MZ = "MS:1000040"
SCAN_START, MINUTES = "MS:1000016", "UO:0000031"
POSITIVE, NEGATIVE = "MS:1000130", "MS:1000129"
BITS_64, ZLIB, MZ_ARRAY, INTENSITY_ARRAY = "MS:1000523", "MS:1000574", "MS:1000514", "MS:1000515"
CID = "MS:1000133"

_CV = "array<struct<_accession:string,_value:string,_unitAccession:string>>"
MZML_SPECTRUM = f"""
_id string, _index int, cvParam {_CV},
scanList struct<scan:array<struct<cvParam:{_CV}>>>,
precursorList struct<precursor:array<struct<
selectedIonList:struct<selectedIon:array<struct<cvParam:{_CV}>>>,
ionSelection:struct<cvParam:{_CV}>,activation:struct<cvParam:{_CV}>>>>,
binaryDataArrayList struct<binaryDataArray:array<struct<cvParam:{_CV},`binary`:string>>>
"""


def _decode_arrays(batches):
    """mzML: one array of m/z and one of intensity, little-endian."""
    for batch in batches:
        peaks = []
        rows = zip(batch["_m"], batch["_m64"], batch["_mz"], batch["_i"], batch["_i64"], batch["_iz"])
        for m, m64, mzip, i, i64, izip in rows:
            mz = _floats(m, 64 if m64 else 32, False, bool(mzip))
            intensity = _floats(i, 64 if i64 else 32, False, bool(izip))
            peaks.append([{"mz": a, "intensity": b} for a, b in zip(mz, intensity) if b > 0])
        yield batch.drop(columns=["_m", "_m64", "_mz", "_i", "_i64", "_iz"]).assign(
            peaks=pd.Series(peaks, index=batch.index))


def read_mzml(spark: SparkSession, path, ms_level: int | None = 2) -> DataFrame:
    """Spectra of mzML files; values are found by accession number.

    Files are cut behind each spectrum, in parallel within a file: Spark's
    reader of XML gives a whole file to one task.
    """
    element = F.regexp_extract("value", r"(?s)^.*(<spectrum\s.*)$", 1)
    pieces = spark.read.option("lineSep", "</spectrum>").text(path).select(element.alias("_text")).filter("_text <> ''")
    raw = once(pieces, "_s", F.from_xml(
        F.concat("_text", F.lit("</spectrum>")), MZML_SPECTRUM.replace("\n", " "))).select("_s.*")

    def value(params: Column, accession: str) -> Column:
        return F.get(F.filter(params, lambda p: p._accession == accession), F.lit(0))._value

    def has(params: Column, accession: str) -> Column:
        return F.coalesce(F.exists(params, lambda p: p._accession == accession), F.lit(False))

    first = lambda c: F.get(c, F.lit(0))
    own = F.col("cvParam")
    precursor = first(F.col("precursorList.precursor"))
    ion = F.coalesce(first(precursor.selectedIonList.selectedIon).cvParam,
                     precursor.ionSelection.cvParam)
    start = F.get(F.filter(first(F.col("scanList.scan")).cvParam,
                           lambda p: p._accession == SCAN_START), F.lit(0))
    seconds = start._value.try_cast("double") * F.when(
        start._unitAccession == MINUTES, 60.0).otherwise(1.0)
    arrays = F.col("binaryDataArrayList.binaryDataArray")
    pick = lambda accession: first(F.filter(
        arrays, lambda a: has(a.cvParam, accession)))
    m, i = pick(MZ_ARRAY), pick(INTENSITY_ARRAY)
    level = value(own, MS_LEVEL).try_cast("int")
    if ms_level is not None:
        raw = raw.filter(level == ms_level)
    flat = raw.select(
        F.coalesce(scan_id_from_text(F.col("_id")), F.col("_index").cast("string")).alias("id"),
        F.col("_id").alias("label"),
        scan_id_from_text(F.col("_id")).try_cast("int").alias("scan_number"),
        level.alias("ms_level"),
        F.when(has(own, NEGATIVE), "minus").otherwise("plus").alias("polarity"),
        seconds.alias("rt_sec"),
        F.when(has(precursor.activation.cvParam, CID), "CID").alias("activation"),
        F.coalesce(value(ion, SELECTED_MZ), value(ion, OLD_SELECTED_MZ)).try_cast(
            "double").alias("_pmz"),
        F.coalesce(value(ion, CHARGE_STATE).try_cast("int"), F.lit(0)).alias("_z"),
        value(ion, PEAK_INTENSITY).try_cast("double").alias("_pi"),
        m["binary"].alias("_m"), has(m.cvParam, BITS_64).alias("_m64"),
        has(m.cvParam, ZLIB).alias("_mz"),
        i["binary"].alias("_i"), has(i.cvParam, BITS_64).alias("_i64"),
        has(i.cvParam, ZLIB).alias("_iz"))
    dropped = ("_m", "_m64", "_mz", "_i", "_i64", "_iz")
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in flat.schema.fields
            if f.name not in dropped]
    decoded = flat.mapInPandas(_decode_arrays, ", ".join([*kept, f"peaks {PEAKS}"]))
    return _complete(decoded.withColumn("precursor", _precursor(
        F.col("_pmz"), F.col("_z"), F.col("_pi"))).withColumn("peaks", F.array_sort("peaks")))


READERS = {"mgf": read_mgf, "mzxml": read_mzxml, "mzml": read_mzml}


def read_spectra(spark: SparkSession, path: str) -> DataFrame:
    """Reader by file extension."""
    kind = extension(path)
    if kind not in READERS:
        raise ValueError(f"cannot read spectra from {path}: unknown extension")
    return READERS[kind](spark, path)


def combine_scans(spark: SparkSession, paths: list[str], max_scans: int | None = None) -> DataFrame:
    """Scans of many mzXML files as one frame, if asked only the first ones by scan number."""
    return read_mzxml(spark, paths, first=max_scans)
