"""Queries over spectra: conditioning, filters, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from specengine.functions import masses as M
from specengine.functions import spectrum as SP
from specengine.operators import condition as C
from specengine.operators import filters as X
from specengine.operators.joins import add_precursor_mass
from specengine.plans.registry import query
from specengine.plans.tables import ctes, peak_rows, precursors, spectra, table

# One row per spectrum with a list of peaks, and the steps on that list.
SPECTRA_SQL = ctes("peak_rows", "precursors", """spectra AS (
  SELECT p.id, p.pmz, p.z, p.mass, k.peaks FROM precursors p JOIN (
    SELECT id, list({'mz': mz, 'i': intensity} ORDER BY mz) AS peaks FROM peaks GROUP BY id) k ON p.id = k.id)""")


def remove_isotopes_sql(peaks: str, above: float) -> str:
    high = f"list_filter({peaks}, lambda p: p.mz > {above}e0)"
    return f"""CASE WHEN len({high}) = 0 THEN {peaks} ELSE
    list_reduce(list_transform({high}, lambda p: [p]), lambda a, x:
      CASE WHEN x[1].mz < a[len(a)].mz + 0.95e0 THEN
        CASE WHEN a[len(a)].i > x[1].i THEN a ELSE list_concat(a[1:len(a) - 1], x) END
      ELSE list_concat(a, x) END) END"""


def remove_parent_sql(peaks: str) -> str:
    return (f"list_filter({peaks}, lambda p: p.mz = pmz OR abs(p.mz - pmz) >= 2.0e0 / greatest(1, z))")


def normalize_sql(peaks: str) -> str:
    return f"""list_filter(list_transform({peaks}, lambda p: {{'mz': p.mz,
      'i': p.i / (list_max(list_transform({peaks}, lambda q: q.i)) / 100.0e0)}}), lambda p: p.i >= 1)"""


def clean_isotopes_sql(peaks: str) -> str:
    return f"""CASE WHEN len({peaks}) = 0 THEN {peaks} ELSE list_transform([list_reduce(
    list_transform({peaks}, lambda p: {{'o': list_filter([p], lambda q: false), 'l': p, 's': p.mz}}),
    lambda a, x: CASE WHEN x.l.mz - a.s < 1.5e0 AND x.l.mz > 200 THEN
      {{'o': a.o, 'l': CASE WHEN x.l.i > a.l.i THEN x.l ELSE a.l END, 's': a.s}}
      ELSE {{'o': list_append(a.o, a.l), 'l': x.l, 's': x.s}} END)], lambda r: list_append(r.o, r.l))[1] END"""


def conditioned_sql(isotope: float = 200, name: str = "good") -> str:
    """The whole chain with the default limits."""
    return f"""c1 AS (SELECT id, pmz, z, mass, {remove_isotopes_sql('peaks', isotope)} AS peaks
  FROM spectra WHERE z <= 4 AND mass BETWEEN 500 AND 6000),
c2 AS (SELECT id, pmz, z, mass, list_filter({remove_parent_sql('peaks')}, lambda p: p.mz BETWEEN 0 AND 6000) AS peaks FROM c1),
c3 AS (SELECT id, pmz, z, mass, {normalize_sql('peaks')} AS peaks FROM c2 WHERE len(peaks) > 0),
c4 AS (SELECT * FROM c3 WHERE len(peaks) >= 5 AND len(list_filter(peaks, lambda p: p.mz >
    CASE WHEN z < 3 THEN mass - 600.0e0 ELSE mass / z END)) > 0),
{name} AS (SELECT id, pmz, z, mass, {clean_isotopes_sql('peaks')} AS peaks FROM c4)"""


def rows_sql(source: str) -> str:
    return f"""SELECT id, p.mz AS mz, round(p.i, 6) AS intensity
FROM (SELECT id, unnest(peaks) AS p FROM {source})"""


def rows(df):
    return C.explode_peaks(df).select("id", "mz", F.round("intensity", 6).alias("intensity"))


def peaks_query(name, step, sql_step, where="len(peaks) > 0"):
    """Register a step that maps the peak list of every spectrum."""
    @query(name, SPECTRA_SQL.rstrip() + f",\nout_ AS (SELECT id, {sql_step} AS peaks FROM spectra WHERE {where})\n"
           + rows_sql("out_"))
    def run(spark, folder):
        return rows(spectra(spark, folder).withColumn("peaks", step(F.col("peaks"))))


peaks_query("remove_isotopes", lambda p: C.remove_isotopes(p, 150.0), remove_isotopes_sql("peaks", 150))
peaks_query("remove_parent", lambda p: C.remove_parent(
    p, F.col("precursor.mz"), F.col("precursor.charge")), remove_parent_sql("peaks"))
peaks_query("mass_window_filter", lambda p: C.mass_window(p, 400.0, 1500.0),
            "list_filter(peaks, lambda p: p.mz BETWEEN 400.0e0 AND 1500.0e0)")
peaks_query("normalize_dynamic_range", C.normalize_dynamic_range, normalize_sql("peaks"))
peaks_query("clean_isotopes", C.clean_isotopes, clean_isotopes_sql("peaks"))
peaks_query("morpheus_shift", lambda p: C.morpheus_shift(p, F.col("precursor.charge")),
            "list_transform(peaks, lambda p: {'mz': p.mz + z * 1.007825035e0, 'i': p.i})")
peaks_query("top_n_peaks", lambda p: C.top_n_peaks(p, 3),
            "list_sort(list_transform(list_sort(list_transform(peaks, lambda p: {'k': -p.i, 'mz': p.mz}))[1:3],"
            " lambda r: {'mz': r.mz, 'i': -r.k}))")
peaks_query("comet_normalize", C.comet_normalize, """list_transform(list_transform(peaks, lambda p:
    {'mz': p.mz, 'i': sqrt(p.i) / sqrt(list_max(list_transform(peaks, lambda q: q.i))) * 100}), lambda p:
    {'mz': p.mz, 'i': CASE WHEN p.i < 5.0 THEN 0.0e0 ELSE 50.0e0 / list_max(list_transform(list_filter(peaks, lambda q:
      floor(q.mz / ((peaks[len(peaks)].mz + 0.5e0) / 10)) = floor(p.mz / ((peaks[len(peaks)].mz + 0.5e0) / 10))),
      lambda q: sqrt(q.i) / sqrt(list_max(list_transform(peaks, lambda r: r.i))) * 100)) * p.i END})""")
peaks_query("probid_truncate_normalize", lambda p: C.probid_normalize(C.probid_truncate(p)),
            """CASE WHEN len(peaks) < 5 THEN peaks ELSE list_transform(peaks, lambda p, i: {'mz': p.mz,
    'i': p.i * (200.0e0 / list_max(list_transform(
      peaks[(i - 1) // (len(peaks) // 5) * (len(peaks) // 5) + 1 : ((i - 1) // (len(peaks) // 5) + 1) * (len(peaks) // 5)],
      lambda q: q.i)))}) END""")


@query("min_peak_count", SPECTRA_SQL + "SELECT id, CAST(len(peaks) AS INTEGER) AS n FROM spectra WHERE len(peaks) >= 5")
def min_peak_count(spark, folder):
    return spectra(spark, folder).filter(F.size("peaks") >= 5).select("id", F.size("peaks").alias("n"))


@query("is_noise", SPECTRA_SQL + """SELECT id, len(list_filter(peaks, lambda p: p.mz >
  CASE WHEN z < 3 THEN mass - 600.0e0 ELSE mass / z END)) = 0 AS noise FROM spectra""")
def is_noise(spark, folder):
    df = add_precursor_mass(spectra(spark, folder))
    return df.select("id", C.is_noise(
        F.col("peaks"), F.col("precursor_mass"), F.col("precursor.charge")).alias("noise"))


@query("condition_spectra", SPECTRA_SQL.rstrip() + ",\n" + conditioned_sql() + "\n" + rows_sql("good"))
def condition_spectra(spark, folder):
    return rows(C.condition_spectra(spectra(spark, folder)))


def k_rows_sql(source: str = "spectra") -> str:
    """Square roots, one peak per index, windows, unit length."""
    return f"""k0 AS (
  SELECT id, CAST(floor((mass + (z - 1) * 1.007276e0) / z * 2.0e0 + 0.5e0) AS INTEGER) + 10 AS upper_,
         peaks[1].mz AS min_mz, sqrt(list_max(list_transform(peaks, lambda p: p.i))) AS strongest, unnest(peaks) AS p
  FROM {source} WHERE len(peaks) > 0),
k1 AS (
  SELECT id, CASE WHEN abs(p.mz - floor(p.mz)) < 0.00001e0 THEN CAST(floor(p.mz) AS INTEGER)
           ELSE CAST(floor(p.mz / 1.0005e0 + 0.5e0) AS INTEGER) END AS k,
         max(sqrt(p.i)) AS s, min(p.mz) AS mz, min(upper_) AS upper_, min(min_mz) AS min_mz, min(strongest) AS strongest
  FROM k0 GROUP BY 1, 2 HAVING min(p.mz) <= min(upper_)),
k2 AS (SELECT *, 10 + CAST(floor(max(mz) OVER (PARTITION BY id) - min_mz) AS INTEGER) AS span FROM k1),
k3 AS (SELECT *, CAST(floor(span / CASE WHEN span > 3000 THEN 10 WHEN span > 2500 THEN 9 WHEN span > 2000 THEN 8
    WHEN span > 1500 THEN 7 WHEN span > 1000 THEN 6 ELSE 5 END) AS INTEGER) AS size FROM k2),
k4 AS (SELECT *, CAST(floor((k - CAST(floor(min_mz + 0.5e0) AS INTEGER)) / size) AS INTEGER) AS w FROM k3),
k5 AS (SELECT *, max(s) OVER (PARTITION BY id, w) AS top FROM k4),
k6 AS (SELECT id, k, mz, CASE WHEN w >= 0 AND top > 0.05e0 * strongest THEN s * (strongest / top) ELSE s END AS s FROM k5),
knorm AS (SELECT id, k, mz, s / sqrt(sum(s * s) OVER (PARTITION BY id)) AS intensity FROM k6),
kslide AS (
  SELECT * FROM (SELECT id, k, mz, intensity - sum(intensity) OVER (
    PARTITION BY id ORDER BY mz RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) / 101 AS intensity FROM knorm)
  WHERE intensity > 0)"""


@query("k_sqrt_window_normalize", SPECTRA_SQL.rstrip() + ",\n" + k_rows_sql() + """
SELECT id, k, mz, round(intensity, 9) AS intensity FROM knorm""")
def k_sqrt_window_normalize(spark, folder):
    return C.k_sqrt_window_normalize(spectra(spark, folder)).select(
        "id", "k", "mz", F.round("intensity", 9).alias("intensity"))


@query("sliding_mean_subtract", SPECTRA_SQL.rstrip() + ",\n" + k_rows_sql() + """
SELECT id, k, mz, round(intensity, 9) AS intensity FROM kslide""")
def sliding_mean_subtract(spark, folder):
    return C.sliding_mean_subtract(C.k_sqrt_window_normalize(spectra(spark, folder))).select(
        "id", "k", "mz", F.round("intensity", 9).alias("intensity"))


COMET_ROWS_SQL = """cw AS (SELECT id, unnest(peaks) AS p FROM spectra),
cb AS (SELECT id, CAST(floor(p.mz * (1.0e0 / 0.03e0) + 1.0e0) AS INTEGER) AS bin, p.i AS weight FROM cw),
cn AS (SELECT id, bin, max(weight) AS weight FROM (
  SELECT id, bin, weight FROM cb UNION ALL SELECT id, bin - 1, weight / 2 FROM cb
  UNION ALL SELECT id, bin + 1, weight / 2 FROM cb) GROUP BY id, bin)"""


@query("comet_bin_weights", SPECTRA_SQL.rstrip() + ",\n" + COMET_ROWS_SQL + "\nSELECT id, bin, weight FROM cn")
def comet_bin_weights(spark, folder):
    return C.comet_bin_weights(C.explode_peaks(spectra(spark, folder)))


@query("guess_charge", SPECTRA_SQL + """SELECT id, CASE WHEN total = 0 OR below / total > 0.95e0 THEN 1 ELSE 2 END AS guess
FROM (SELECT id, list_sum(list_transform(peaks, lambda p: floor(p.i))) AS total,
  coalesce(list_sum(list_transform(list_filter(peaks, lambda p: p.mz < pmz), lambda p: floor(p.i))), 0) AS below FROM spectra)""")
def guess_charge(spark, folder):
    return spectra(spark, folder).select(
        "id", C.guess_charge(F.col("peaks"), F.col("precursor.mz")).alias("guess"))


@query("spectrum_stats", SPECTRA_SQL + """SELECT id, s AS sum_intensity, m AS max_intensity, round(log10(s), 9) AS log_sum,
  round(log10(m), 9) AS log_max FROM (SELECT id, list_sum(list_transform(peaks, lambda p: p.i)) AS s,
    list_max(list_transform(peaks, lambda p: p.i)) AS m FROM spectra)""")
def spectrum_stats(spark, folder):
    stats = C.spectrum_stats(F.col("peaks"))
    return spectra(spark, folder).select(
        "id", stats["sum_intensity"].alias("sum_intensity"),
        stats["max_intensity"].alias("max_intensity"),
        F.round(stats["log_sum"], 9).alias("log_sum"), F.round(stats["log_max"], 9).alias("log_max"))


@query("spectrum_vector", SPECTRA_SQL + """SELECT id, array_to_string(list_concat(v, list_transform(
    range(0, 64 - len(v)), lambda x: 0)), ' ') AS vector
FROM (SELECT id, list_sort(list_distinct(list_transform(peaks[1:64], lambda p: CAST(floor(p.mz) AS INTEGER)))) AS v FROM spectra)""")
def spectrum_vector(spark, folder):
    return spectra(spark, folder).select("id", F.array_join(
        F.transform(C.spectrum_vector(F.col("peaks")), lambda x: x.cast("string")), " ").alias("vector"))


@query("spectrum_is_scorable", SPECTRA_SQL + """SELECT id, z <= 4 AND mass BETWEEN 500 AND 6000 AND len(peaks) >= 8 AS scorable
FROM spectra""")
def spectrum_is_scorable(spark, folder):
    df = spectra(spark, folder)
    return df.select("id", C.spectrum_is_scorable(df).alias("scorable"))


@query("mass_scored", ctes("precursors") + """
SELECT id, mass FROM precursors WHERE mass BETWEEN 1000 AND 3000""")
def mass_scored(spark, folder):
    df = add_precursor_mass(precursors(spark, folder))
    limits = C.Settings(min_mass=1000.0, max_mass=3000.0)
    return df.filter(C.mass_scored(F.col("precursor_mass"), limits)).select(
        "id", F.col("precursor_mass").alias("mass"))


@query("charge_supported", ctes("precursors") + """
SELECT z AS charge, count(*) AS n FROM precursors WHERE z <= 2 GROUP BY z""")
def charge_supported(spark, folder):
    z = F.col("precursor.charge")
    return precursors(spark, folder).filter(C.charge_supported(z, 2)).groupBy(
        z.alias("charge")).agg(F.count(F.lit(1)).alias("n"))


@query("ms2_only", """SELECT o_orderkey AS id, CAST(1 + o_orderkey % 3 AS INTEGER) AS ms_level
FROM orders WHERE 1 + o_orderkey % 3 <> 1""")
def ms2_only(spark, folder):
    levels = precursors(spark, folder).select("id", (1 + F.col("id") % 3).cast("int").alias("ms_level"))
    return X.ms2_only(levels)


@query("nonempty_id", """SELECT event_id, e AS id FROM (
  SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE event_type END AS e FROM events)
WHERE length(e) > 0""")
def nonempty_id(spark, folder):
    m = F.col("event_id") % 4
    ids = table(spark, folder, "events").select("event_id", F.when(m == 0, "").when(
        m == 1, F.lit(None)).otherwise(F.col("event_type")).alias("id"))
    return X.nonempty_id(ids)


@query("precursor_mass", ctes("precursors") + """
SELECT id, mass, round((mass - 1.007276e0) / z + 1.007276e0, 6) AS mz FROM precursors""")
def precursor_mass(spark, folder):
    return add_precursor_mass(precursors(spark, folder)).select(
        "id", F.col("precursor_mass").alias("mass"),
        F.round(M.mz_from_mass(F.col("precursor_mass"), F.col("precursor.charge")), 6).alias("mz"))


@query("k_mass_index", ctes("peak_rows") + """
SELECT mz, CASE WHEN abs(mz - floor(mz)) < 0.00001e0 THEN CAST(floor(mz) AS INTEGER)
  ELSE CAST(floor(mz / 1.0005e0 + 0.5e0) AS INTEGER) END AS k, count(*) AS n
FROM peaks GROUP BY mz""")
def k_mass_index(spark, folder):
    merged = C.explode_peaks(spectra(spark, folder))
    return merged.groupBy("mz").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "k", M.k_mass_index(F.col("mz")))


@query("scan_id_from_text", """WITH t AS (
  SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'controllerType=0 scan=' || user_id || ' x'
    ELSE 'id' || user_id END AS label FROM events)
SELECT event_id, CASE WHEN contains(label, 'scan=') THEN regexp_extract(label, 'scan=([^ ]*)', 1) ELSE label END AS scan,
  lpad(CAST(event_id AS VARCHAR), 12, '0') AS padded FROM t""")
def scan_id_from_text(spark, folder):
    user = F.col("user_id").cast("string")
    label = F.when(F.col("event_id") % 2 == 0, F.concat(
        F.lit("controllerType=0 scan="), user, F.lit(" x"))).otherwise(F.concat(F.lit("id"), user))
    return table(spark, folder, "events").select(
        "event_id", SP.scan_id_from_text(label).alias("scan"),
        SP.padded_scan_id(F.col("event_id")).alias("padded"))


@query("rt_seconds", """SELECT event_id, CASE event_id % 3 WHEN 2 THEN 0.0e0 ELSE value END AS rt FROM events""")
def rt_seconds(spark, folder):
    value, m = F.col("value").cast("string"), F.col("event_id") % 3
    text = F.when(m == 0, F.concat(F.lit("PT"), value, F.lit("S"))).when(m == 1, value).otherwise("n/a")
    return table(spark, folder, "events").select("event_id", SP.rt_seconds(text).alias("rt"))


@query("fdr_bin", """WITH b AS (
  SELECT event_id, value, CASE WHEN value <= 1e-8 THEN 0 WHEN value >= 1e8 THEN 3199
    ELSE CAST(floor((log10(value) + 8.0e0) / 0.005e0) AS INTEGER) END AS bin FROM events)
SELECT event_id, bin, round(1e-8 * pow(10.0e0, 0.005e0 * bin), 9) AS low FROM b""")
def fdr_bin(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", SP.fdr_bin(F.col("value")).alias("bin")).withColumn(
        "low", F.round(SP.fdr_bin_score(F.col("bin")), 9))


@query("factorial", """SELECT l_linenumber AS n, CAST(factorial(l_linenumber) AS DOUBLE) AS f, count(*) AS rows
FROM lineitem GROUP BY l_linenumber""")
def factorial(spark, folder):
    return table(spark, folder, "lineitem").groupBy(F.col("l_linenumber").alias("n")).agg(
        F.count(F.lit(1)).alias("rows")).withColumn("f", SP.factorial(F.col("n")))


@query("hconvert", """SELECT event_id, round(0.05e0 * value, 9) AS k, round(0.05e0 * log10(value), 9) AS tandem FROM events""")
def hconvert(spark, folder):
    v = F.col("value")
    return table(spark, folder, "events").select(
        "event_id", F.round(SP.hconvert(v), 9).alias("k"),
        F.round(SP.hconvert(v, "tandem"), 9).alias("tandem"))


@query("assemble_spectra", ctes("peak_rows") + "SELECT id, mz, intensity FROM peaks")
def assemble_spectra(spark, folder):
    return C.explode_peaks(C.assemble_spectra(
        peak_rows(spark, folder), precursors(spark, folder))).select("id", "mz", "intensity")
