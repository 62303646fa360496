"""Queries for statistics, discovery rates, comparisons, samples, order and sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from specengine.operators import compare as CM
from specengine.operators import fdr as D
from specengine.operators import filters as X
from specengine.operators import mapreduce as MR
from specengine.operators import order as O
from specengine.operators import partition as PT
from specengine.operators import sets as SE
from specengine.operators import stats as ST
from specengine.plans.registry import query
from specengine.plans.tables import ctes, hits, result_set, table

HITS_SQL = ctes("hits")
#: The sampling hash of a key.
HASH_SQL = "CAST('0x' || substr(md5('{seed}|' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT)"
BIN_SQL = ("CASE WHEN score <= 1e-8 THEN 0 WHEN score >= 1e8 THEN 3199 "
           "ELSE CAST(floor((log10(score) + 8.0e0) / 0.005e0) AS INTEGER) END")
COUNTS_SQL = HITS_SQL.rstrip() + f""",
counts AS (SELECT {BIN_SQL} AS bin, CAST(count_if(NOT is_decoy) AS BIGINT) AS n_true,
  CAST(count_if(is_decoy) AS BIGINT) AS n_false FROM hits GROUP BY 1)
"""
AT_SQL = """SELECT bin, n_true, n_false, CASE WHEN n_true + n_false = 0 THEN 0 ELSE n_false / (n_true + n_false) END AS fdr
FROM (SELECT bin, CAST(sum(n_true) OVER w AS BIGINT) AS n_true, CAST(sum(n_false) OVER w AS BIGINT) AS n_false
  FROM counts WINDOW w AS (ORDER BY bin {order}))"""


@query("fdr_counts", COUNTS_SQL + "SELECT bin, n_true, n_false FROM counts")
def fdr_counts(spark, folder):
    return D.fdr_counts(hits(spark, folder))


@query("fdr_counts_linear", HITS_SQL + """
SELECT CAST(least(greatest(floor(score), 0), 99) AS INTEGER) AS bin, CAST(count_if(NOT is_decoy) AS BIGINT) AS n_true,
  CAST(count_if(is_decoy) AS BIGINT) AS n_false FROM hits GROUP BY 1""")
def fdr_counts_linear(spark, folder):
    return D.fdr_counts_linear(hits(spark, folder))


@query("fdr_at_score", COUNTS_SQL + AT_SQL.format(order="DESC"))
def fdr_at_score(spark, folder):
    return D.fdr_at_score(D.fdr_counts(hits(spark, folder)))


@query("fdr_at_score_low", COUNTS_SQL + AT_SQL.format(order="ASC"))
def fdr_at_score_low(spark, folder):
    return D.fdr_at_score(D.fdr_counts(hits(spark, folder)), high_is_better=False)


@query("fdr_table", COUNTS_SQL.rstrip() + """,
grid AS (SELECT CAST(i AS INTEGER) AS step, 1.0e0 * pow(1.05e0, i) AS score FROM range(0, 95) r(i)),
binned AS (SELECT step, score, CASE WHEN score <= 1e-8 THEN 0 ELSE CAST(floor((log10(score) + 8.0e0) / 0.005e0) AS INTEGER) END AS g FROM grid),
t AS (SELECT step, score, CAST(coalesce(sum(n_true), 0) AS BIGINT) AS n_true, CAST(coalesce(sum(n_false), 0) AS BIGINT) AS n_false
  FROM binned LEFT JOIN counts ON bin >= g GROUP BY 1, 2)
SELECT step, round(score, 6) AS score, n_true, n_false, CASE WHEN n_true + n_false = 0 THEN 0 ELSE n_false / (n_true + n_false) END AS fdr,
  n_true / first_value(n_true) OVER (ORDER BY step) AS tpr, n_false / first_value(n_false) OVER (ORDER BY step) AS fpr
FROM t""")
def fdr_table(spark, folder):
    return D.fdr_table(hits(spark, folder), 1.0, 100.0).withColumn("score", F.round("score", 6))


@query("fdr_hits", """WITH h AS (
  SELECT event_id, 1 + event_id % 3 AS rank, [CASE WHEN user_id % 2 = 0 THEN 'DECOY_' ELSE '' END || user_id,
    CASE WHEN event_id % 4 = 0 THEN 'DECOY_' ELSE '' END || event_type] AS proteins, event_type = 'error' AS is_modified
  FROM events)
SELECT is_modified, starts_with(proteins[1], 'DECOY_') AS is_decoy, count(*) AS n FROM h
WHERE rank <= 2 AND starts_with(proteins[1], 'DECOY_') = starts_with(proteins[2], 'DECOY_') GROUP BY 1, 2""")
def fdr_hits(spark, folder):
    mark = lambda c, rest: F.concat(F.when(c, "DECOY_").otherwise(""), rest)
    raw = table(spark, folder, "events").select(
        (1 + F.col("event_id") % 3).alias("rank"),
        F.array(mark(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")),
                mark(F.col("event_id") % 4 == 0, F.col("event_type"))).alias("proteins"),
        (F.col("event_type") == "error").alias("is_modified"))
    return D.fdr_hits(raw, 2).groupBy("is_modified", "is_decoy").agg(F.count(F.lit(1)).alias("n"))


@query("filtered_fdr", HITS_SQL.rstrip() + f""",
counts AS (SELECT is_modified, {BIN_SQL} AS bin, CAST(count_if(NOT is_decoy) AS BIGINT) AS n_true,
  CAST(count_if(is_decoy) AS BIGINT) AS n_false FROM hits WHERE score >= 50 GROUP BY 1, 2)
SELECT is_modified, bin, n_true, n_false, CASE WHEN n_true + n_false = 0 THEN 0 ELSE n_false / (n_true + n_false) END AS fdr
FROM (SELECT is_modified, bin, CAST(sum(n_true) OVER w AS BIGINT) AS n_true, CAST(sum(n_false) OVER w AS BIGINT) AS n_false
  FROM counts WINDOW w AS (PARTITION BY is_modified ORDER BY bin DESC))""")
def filtered_fdr(spark, folder):
    return D.filtered_fdr(hits(spark, folder), 50.0, ["is_modified"])


@query("score_range_filter", HITS_SQL + "SELECT scan, score FROM hits WHERE score BETWEEN 10 AND 20")
def score_range_filter(spark, folder):
    h = hits(spark, folder)
    return h.filter(D.score_range_filter(F.col("score"), 10.0, 20.0)).select("scan", "score")


@query("and_filter", HITS_SQL + "SELECT scan FROM hits WHERE score >= 10 AND is_modified AND NOT is_decoy")
def and_filter(spark, folder):
    return hits(spark, folder).filter(D.and_filter(
        [F.col("score") >= 10, F.col("is_modified"), ~F.col("is_decoy")])).select("scan")


@query("or_filter", HITS_SQL + "SELECT scan FROM hits WHERE score >= 100 OR is_modified")
def or_filter(spark, folder):
    return hits(spark, folder).filter(D.or_filter(
        [F.col("score") >= 100, F.col("is_modified")])).select("scan")


@query("min_hyperscore", HITS_SQL + "SELECT scan, score AS hyperscore FROM hits WHERE score > 50")
def min_hyperscore(spark, folder):
    from specengine.operators.psm import min_hyperscore as op

    return op(hits(spark, folder).select("scan", F.col("score").alias("hyperscore")))


@query("report_min_hyperscore", HITS_SQL + "SELECT scan, score AS hyperscore FROM hits WHERE score >= 100")
def report_min_hyperscore(spark, folder):
    return D.report_min_hyperscore(
        hits(spark, folder).select("scan", F.col("score").alias("hyperscore")), 100.0)


@query("protein_hits", HITS_SQL + """
SELECT protein, count(DISTINCT scan || '/' || peptide) AS n_hits, count(DISTINCT peptide) AS n_peptides
FROM hits WHERE "rank" = 1 GROUP BY protein""")
def protein_hits(spark, folder):
    rows = D.protein_hits(hits(spark, folder))
    per = rows.groupBy("protein", "peptide").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("protein").agg(
        F.sum("n").alias("n_hits"), F.count(F.lit(1)).alias("n_peptides"))


@query("protein_hits_unique", HITS_SQL.rstrip() + """,
h AS (SELECT DISTINCT protein, scan, peptide || '-' || floor(score) AS peptide FROM hits),
u AS (SELECT peptide FROM h GROUP BY peptide HAVING count(DISTINCT protein) = 1)
SELECT h.protein, h.scan, h.peptide FROM h JOIN u USING (peptide)""")
def protein_hits_unique(spark, folder):
    finer = hits(spark, folder).withColumn("peptide", F.concat_ws(
        "-", "peptide", F.concat(F.floor("score").cast("string"), F.lit(".0"))))
    return D.protein_hits(finer, unique_only=True)


@query("roc_points", """WITH q AS (SELECT value / 1000.0e0 AS q FROM events)
SELECT CAST(i AS INTEGER) AS step, round(i * 0.001e0, 6) AS q, (SELECT count(*) FROM q WHERE floor(q.q / 0.001e0) < i) AS n_below
FROM range(1, 51) r(i)""")
def roc_points(spark, folder):
    scores = table(spark, folder, "events").select((F.col("value") / 1000.0).alias("q"))
    return D.roc_points(scores).withColumn("q", F.round("q", 6))


# ---- statistics -------------------------------------------------------------------

@query("statistics", """SELECT event_type, count(value) AS n, round(sum(value), 4) AS total, round(sum(value * value), 3) AS total_squares,
  min(value) AS least, max(value) AS greatest, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd
FROM events GROUP BY event_type""")
def statistics(spark, folder):
    return _rounded(ST.statistics(table(spark, folder, "events"), "value", ["event_type"]))


@query("variable_statistics", """SELECT user_id, count(value) AS n, round(sum(value), 4) AS total, round(sum(value * value), 3) AS total_squares,
  round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM events GROUP BY user_id""")
def variable_statistics(spark, folder):
    return _rounded(ST.variable_statistics(table(spark, folder, "events"), "value", ["user_id"]))


def _rounded(df):
    digits = {"total": 4, "total_squares": 3, "mean": 6, "sd": 6}
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("linear_fit", """WITH f AS (SELECT l_returnflag, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS a,
  regr_intercept(l_extendedprice, l_quantity) AS b, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, n, round(a, 6) AS slope, round(b, 4) AS y_intercept, round(r, 6) AS correlation, round(-b / a, 4) AS x_intercept FROM f""")
def linear_fit(spark, folder):
    fit = ST.linear_fit(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return fit.withColumns({"slope": F.round("slope", 6), "y_intercept": F.round("y_intercept", 4),
                            "correlation": F.round("correlation", 6),
                            "x_intercept": F.round("x_intercept", 4)})


@query("histogram_fn", """SELECT CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 21 ELSE CAST(floor(value / 5) AS BIGINT) + 1 END AS bin, count(*) AS n
FROM events GROUP BY 1""")
def histogram_fn(spark, folder):
    return ST.histogram_fn(table(spark, folder, "events"), "value", 0.0, 100.0, 20)


@query("count_by_key", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def count_by_key(spark, folder):
    return ST.count_by_key(table(spark, folder, "events"), ["user_id", "event_type"])


@query("show_counts", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, 1")
def show_counts(spark, folder):
    return ST.show_counts(table(spark, folder, "lineitem"), ["l_suppkey"])


@query("max_by_radius", """SELECT sqrt(l_quantity * l_quantity + l_discount * l_discount) AS radius, l_quantity, l_discount
FROM lineitem ORDER BY 1 DESC, 2 DESC, 3 DESC LIMIT 1""")
def max_by_radius(spark, folder):
    return ST.max_by_radius(table(spark, folder, "lineitem"), "l_quantity", "l_discount")


@query("group_values", """SELECT user_id, count(*) AS n_values, count(DISTINCT value) AS n_distinct, round(sum(value), 4) AS total,
  min(value) AS least FROM events GROUP BY user_id""")
def group_values(spark, folder):
    grouped = ST.group_values(table(spark, folder, "events"), "user_id", "value", chunk=25)
    rows = grouped.select("user_id", F.explode("values").alias("v")).select("user_id", "v.*")
    return rows.groupBy("user_id").agg(
        F.sum("n").alias("n_values"), F.count(F.lit(1)).alias("n_distinct"),
        F.round(F.sum(F.col("value") * F.col("n")), 4).alias("total"), F.min("value").alias("least"))


@query("distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct(spark, folder):
    return table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("row_metrics", "SELECT count(*) AS n, round(sum(value), 4) AS total FROM events")
def row_metrics(spark, folder):
    """Counters observed by a job that runs anyway."""
    from pyspark.sql import Observation

    seen = Observation("events")
    df = MR.observed(table(spark, folder, "events"), seen, F.count(F.lit(1)).alias("n"),
                     F.round(F.sum("value"), 4).alias("total"))
    df.write.format("noop").mode("overwrite").save()
    values = seen.get
    return spark.createDataFrame([(values["n"], values["total"])], "n long, total double")


# ---- comparison of two result sets ---------------------------------------------------

RESULTS_SQL = """WITH a AS (SELECT user_id AS id, event_type AS peptide, value AS score FROM events WHERE event_id % 2 = 0),
b AS (SELECT user_id AS id, event_type AS peptide, value AS score FROM events WHERE event_id % 2 = 1),
ba AS (SELECT id, arg_max(peptide, (score, peptide)) AS peptide, max(score) AS score FROM a GROUP BY id),
bb AS (SELECT id, arg_max(peptide, (score, peptide)) AS peptide, max(score) AS score FROM b GROUP BY id)
"""


@query("compare_results", RESULTS_SQL + """
SELECT ba.id, ba.peptide, ba.score, CASE WHEN bb.id IS NULL THEN 'no_scan'
  WHEN ba.peptide = bb.peptide AND abs(ba.score - bb.score) / greatest(ba.score, bb.score) <= 0.03 THEN 'perfect'
  WHEN ba.peptide = bb.peptide THEN 'same_peptide'
  WHEN EXISTS (SELECT 1 FROM b WHERE b.id = ba.id AND b.peptide = ba.peptide) THEN 'lower_rank'
  ELSE 'other_peptide' END AS class
FROM ba LEFT JOIN bb ON ba.id = bb.id""")
def compare_results(spark, folder):
    return CM.compare_results(result_set(spark, folder, 0), result_set(spark, folder, 1)).select(
        "id", "peptide", "score", "class")


@query("tied_scores", """WITH s AS (SELECT user_id AS id, floor(value) AS score, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2),
t AS (SELECT id, max(score) AS score, arg_max(n, score) AS n FROM s GROUP BY id)
SELECT CAST(score AS INTEGER) AS score_bin, count(*) AS n_scans FROM t WHERE n > 1 GROUP BY 1""")
def tied_scores(spark, folder):
    whole = result_set(spark, folder, 0).withColumn("score", F.floor("score"))
    return CM.tied_scores(whole)


@query("comparison_summary", RESULTS_SQL + """
SELECT CASE WHEN bb.id IS NULL THEN 'only_a' WHEN ba.id IS NULL THEN 'only_b' WHEN ba.peptide = bb.peptide THEN 'equal'
  WHEN abs(ba.score - bb.score) / greatest(ba.score, bb.score) < 0.2 THEN 'close'
  WHEN ba.score > bb.score AND abs(ba.score - bb.score) / greatest(ba.score, bb.score) > 0.5 THEN 'a_much_better'
  WHEN ba.score > bb.score THEN 'a_better'
  WHEN abs(ba.score - bb.score) / greatest(ba.score, bb.score) > 0.5 THEN 'b_much_better' ELSE 'b_better' END AS class, count(*) AS n
FROM ba FULL JOIN bb ON ba.id = bb.id GROUP BY 1""")
def comparison_summary(spark, folder):
    return CM.comparison_summary(result_set(spark, folder, 0), result_set(spark, folder, 1))


@query("found_in_top", RESULTS_SQL + """
SELECT ba.id FROM ba WHERE EXISTS (SELECT 1 FROM b WHERE b.id = ba.id AND b.peptide = ba.peptide)""")
def found_in_top(spark, folder):
    return CM.found_in_top(result_set(spark, folder, 0), result_set(spark, folder, 1))


# ---- samples, order, sets, placement ---------------------------------------------------

@query("percentile_filter", f"SELECT o_orderkey FROM orders WHERE {HASH_SQL.format(seed=0, key='o_orderkey')} % 100 BETWEEN 10 AND 29")
def percentile_filter(spark, folder):
    return X.percentile_filter(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", 10, 30)


@query("percentile_filter_complete", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_distinct FROM orders")
def percentile_filter_complete(spark, folder):
    """Ten ranges of ten hundredths together hold every row once."""
    df = table(spark, folder, "orders").select("o_orderkey")
    parts = [X.percentile_filter(df, "o_orderkey", i, i + 10) for i in range(0, 100, 10)]
    per = reduce(lambda a, b: a.unionByName(b), parts).groupBy("o_orderkey").agg(
        F.count(F.lit(1)).alias("k"))
    return per.agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_distinct"))


@query("nofk_filter", """SELECT o_orderkey FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE (i + 2) % 5 = 0""")
def nofk_filter(spark, folder):
    return X.nofk_filter(table(spark, folder, "orders").select("o_orderkey"), ["o_orderkey"], 5, 2)


@query("first_n", "SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 100")
def first_n(spark, folder):
    return X.first_n(table(spark, folder, "events").select("event_id", "value"), ["value", "event_id"], 100)


@query("random_fraction", f"SELECT event_id FROM events WHERE {HASH_SQL.format(seed=17, key='event_id')} < {round(0.2 * 2**32)}")
def random_fraction(spark, folder):
    return X.random_fraction(table(spark, folder, "events").select("event_id"), 0.2, ["event_id"])


@query("select_middle_scans", """WITH o AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events)
SELECT event_id FROM o WHERE i >= (n - 500) // 2 AND i < (n - 500) // 2 + 500""")
def select_middle_scans(spark, folder):
    return X.select_middle_scans(
        table(spark, folder, "events").select("event_id", "ts"), ["ts", "event_id"], 500).select("event_id")


@query("index_by_order", "SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS index FROM events")
def index_by_order(spark, folder):
    return O.index_by_order(table(spark, folder, "events").select("event_id", "value"),
                            ["value", "event_id"]).select("event_id", "index")


@query("sort_by_key", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey")
def sort_by_key(spark, folder):
    return O.sort_by_key(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")


@query("best_sample", """SELECT event_id AS id, value / 1000.0e0 AS expect FROM events WHERE value / 1000.0e0 < 0.001 ORDER BY event_id LIMIT 6""")
def best_sample(spark, folder):
    scans = table(spark, folder, "events").select(
        F.col("event_id").alias("id"), (F.col("value") / 1000.0).alias("expect"))
    return O.best_sample(scans)


@query("common_ids", "SELECT user_id AS id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE value > 100")
def common_ids(spark, folder):
    e = table(spark, folder, "events").withColumnRenamed("user_id", "id")
    return SE.common_ids(e.filter(F.col("event_type") == "error"), e.filter(F.col("value") > 100))


@query("uncommon_ids", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def uncommon_ids(spark, folder):
    rich = table(spark, folder, "orders").filter(F.col("o_totalprice") > 300000)
    return SE.uncommon_ids(table(spark, folder, "customer").select(F.col("c_custkey").alias("id")),
                           rich.select(F.col("o_custkey").alias("id")))


@query("union_sources", """SELECT doc_id AS id, lang, CAST(NULL AS VARCHAR) AS role, CAST(length(text) AS INTEGER) AS n FROM documents
UNION ALL SELECT conv_id, NULL, role, length(text) FROM conversations""")
def union_sources(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang", F.length("text").alias("n"))
    talk = table(spark, folder, "conversations").select(F.col("conv_id").alias("id"), "role", F.length("text").alias("n"))
    return SE.union_sources(docs, talk)


@query("people_parquet_query", """SELECT c_mktsegment AS segment, count(*) AS n, min(c_acctbal) AS least FROM customer
WHERE c_acctbal BETWEEN 1000 AND 5000 GROUP BY 1""")
def people_parquet_query(spark, folder):
    """Rows to Parquet, then SQL over them."""
    from specengine.session import scratch_path

    path = scratch_path(spark, "people")
    table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").write.parquet(path)
    return MR.run_sql(spark.read.parquet(path), """
        SELECT c_mktsegment AS segment, count(*) AS n, min(c_acctbal) AS least FROM people
        WHERE c_acctbal BETWEEN 1000 AND 5000 GROUP BY c_mktsegment""", "people")


@query("generate_rows", "SELECT count(*) AS n, count(*) AS n_ids FROM lineitem")
def generate_rows(spark, folder):
    """As many generated rows as the table has, over 16 partitions."""
    from specengine.sources.generate import generate_rows as op

    size = table(spark, folder, "lineitem").count()
    return op(spark, size, 16).agg(F.count(F.lit(1)).alias("n"),
                                   F.countDistinct("id").alias("n_ids"))


@query("first_last_name", """SELECT c_custkey, string_split(c_name || ' ' || c_mktsegment, ' ')[1] AS first, c_mktsegment AS last FROM customer""")
def first_last_name(spark, folder):
    from specengine.functions import text as T

    name = F.concat_ws(" ", "c_name", "c_mktsegment")
    return table(spark, folder, "customer").select(
        "c_custkey", T.first_name(name).alias("first"), T.last_name(name).alias("last"))


def _places(df, key):
    """Per key: its rows, the partitions that hold them, and the highest of these."""
    at = F.spark_partition_id()
    return df.select(key.alias("key"), at.alias("at")).groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("at").alias("places"), F.max("at").alias("last")).select(
        "key", "n", "places", "last")


def _inside(df, key, n):
    return _places(df, key).withColumn("inside", F.col("last") < n).drop("last")


@query("by_hash", "SELECT user_id AS key, count(*) AS n, 1::BIGINT AS places, true AS inside FROM events GROUP BY 1")
def by_hash(spark, folder):
    """All rows of a key lie in one of the partitions asked for."""
    return _inside(PT.by_hash(table(spark, folder, "events"), 7, "user_id"), F.col("user_id"), 7)


@query("by_mass", """SELECT CAST(floor(p_retailprice) AS INTEGER) AS key, count(*) AS n, 1::BIGINT AS places, true AS inside
FROM part GROUP BY 1""")
def by_mass(spark, folder):
    """All rows of a whole mass lie in one partition."""
    return _inside(PT.by_mass(table(spark, folder, "part"), 7, "p_retailprice"), F.col("p_retailprice").cast("int"), 7)


@query("by_first_letter", """SELECT upper(substr(p_name, 1, 1)) AS letter, count(*) AS n, count(DISTINCT p_name) AS n_words,
  count(DISTINCT p_name) AS n_places, 0::BIGINT AS n_crossing FROM part GROUP BY 1""")
def by_first_letter(spark, folder):
    """A word lies in one partition, and no partition reaches into the words of the next one."""
    placed = PT.by_first_letter(table(spark, folder, "part"), "p_name")
    word = F.struct(F.ascii(F.upper(F.substring("p_name", 1, 1))).alias("letter"), F.col("p_name").alias("word"))
    rows = placed.select("p_name", word.alias("w"), F.spark_partition_id().alias("at"))
    ranges = rows.groupBy("at").agg(F.min("w").alias("low"), F.max("w").alias("high"))
    crossing = ranges.alias("a").join(ranges.alias("b"), F.expr("a.at < b.at AND a.high >= b.low")).select(
        F.expr("a.at").alias("at")).distinct().withColumn("crossing", F.lit(True))
    return rows.join(F.broadcast(crossing), "at", "left").groupBy(
        F.upper(F.substring("p_name", 1, 1)).alias("letter")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("p_name").alias("n_words"),
        F.countDistinct("p_name", "at").alias("n_places"), F.count("crossing").alias("n_crossing"))


@query("by_column", "SELECT conv_id AS key, count(*) AS n, 1::BIGINT AS places, true AS inside FROM conversations GROUP BY 1")
def by_column(spark, folder):
    return _inside(PT.by_column(table(spark, folder, "conversations"), 5, "conv_id"), F.col("conv_id"), 5)


@query("repartition_if_needed", """SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total, 12::BIGINT AS n_before,
  6::BIGINT AS n_after FROM events""")
def repartition_if_needed(spark, folder):
    wide = PT.repartition_if_needed(table(spark, folder, "events"), 12)
    few = PT.coalesce(wide, 6)
    used = lambda df: PT.partition_sizes(df).agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"))
    before, after = used(wide).toDF("n_before", "n"), used(few).toDF("n_after", "n")
    return few.agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("total")).join(before, "n").join(after, "n")
