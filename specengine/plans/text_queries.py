"""Queries over lines and words."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import functions as F

from specengine.functions import text as T
from specengine.operators import mapreduce as MR
from specengine.operators import text as X
from specengine.plans.registry import query
from specengine.plans.tables import conversation_lines, document_lines, table
from specengine.session import scratch_path, spread

#: Upper case as in Java, where the sharp s becomes two letters.
UPPER = "upper(replace({}, 'ß', 'SS'))"
WORDS_SQL = """WITH w AS (
  SELECT regexp_replace(""" + UPPER.format("w") + """, '[^\\p{{L}}]', '', 'g') AS word
  FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM {source}))
"""
LETTERS_SQL = "unnest(regexp_extract_all(" + UPPER.format("text") + ", '\\p{L}+'))"
#: Edit distances of the checking engine count bytes, so each accented letter becomes one control character there.
ONE_BYTE = "translate(lower({}), 'óéèñüöäßêíç', " + " || ".join(f"chr({i})" for i in (*range(1, 9), 14, 15, 16)) + ")"


def documents(spark, folder):
    return spread(table(spark, folder, "documents").select("doc_id", "text"))


@query("word_count", WORDS_SQL.format(source="documents") + "SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word")
def word_count(spark, folder):
    return X.word_count(documents(spark, folder))


@query("word_count_sorted_runs", WORDS_SQL.format(source="conversations") + """
SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word ORDER BY word""")
def word_count_sorted_runs(spark, folder):
    return X.word_count(table(spark, folder, "conversations")).orderBy("word")


@query("word_stats", """WITH d AS (SELECT text AS t FROM documents),
w AS (SELECT length(word) AS l FROM (SELECT regexp_replace(upper(replace(unnest(regexp_split_to_array(t, '\\s+')), 'ß', 'SS')), '[^\\p{L}]', '', 'g') AS word FROM d) WHERE word <> ''),
a AS (SELECT count(*) AS words, CAST(sum(l) AS BIGINT) AS letters, avg(l) AS mean_word, stddev_samp(l) AS sd_word, max(l) AS longest_word FROM w),
b AS (SELECT count(*) AS lines, avg(length(t)) AS mean_line, stddev_samp(length(t)) AS sd_line, max(length(t)) AS longest_line FROM d)
SELECT words, letters, round(mean_word, 6) AS mean_word, round(sd_word, 6) AS sd_word, longest_word, lines,
  round(mean_line, 6) AS mean_line, round(sd_line, 5) AS sd_line, longest_line FROM a, b""")
def word_stats(spark, folder):
    return X.word_stats(documents(spark, folder)).withColumns({
        "mean_word": F.round("mean_word", 6), "sd_word": F.round("sd_word", 6),
        "mean_line": F.round("mean_line", 6), "sd_line": F.round("sd_line", 5)})


@query("case_variant_count", """WITH t AS (SELECT regexp_replace(lower(text), '[^\\p{L}]', '', 'g') AS t FROM documents),
g AS (SELECT substr(t, i, 3) AS gram, count(*) AS n FROM t, unnest(range(1, length(t) - 1)) AS r(i) GROUP BY 1)
SELECT CASE WHEN m & 1 > 0 THEN upper(replace(gram[1], 'ß', 'SS')) ELSE gram[1] END || CASE WHEN m & 2 > 0 THEN upper(replace(gram[2], 'ß', 'SS')) ELSE gram[2] END
  || CASE WHEN m & 4 > 0 THEN upper(replace(gram[3], 'ß', 'SS')) ELSE gram[3] END AS variant, n
FROM g, range(0, 8) k(m)""")
def case_variant_count(spark, folder):
    return X.case_variant_count(documents(spark, folder), 3)


LINE_MATCH_SQL = """,
s AS (SELECT a.chapter, a.line_no, b.line_no AS other, CASE WHEN greatest(length(a.line), length(b.line)) = 0 THEN 1.0e0 ELSE
    CAST(greatest(length(a.line), length(b.line)) - levenshtein(a.line, b.line) AS DOUBLE) / greatest(length(a.line), length(b.line)) END AS similarity
  FROM lines a JOIN lines b ON a.chapter = b.chapter AND a.line_no <> b.line_no AND abs(a.line_no - b.line_no) <= 200)
SELECT chapter, line_no, other AS best_line_no, similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY chapter, line_no ORDER BY similarity DESC, other) AS r FROM s) WHERE r = 1"""


@query("best_line_match", f"""WITH lines AS (SELECT CAST(doc_id AS VARCHAR) AS chapter, i - 1 AS line_no,
    {ONE_BYTE.format("parts[i]")} AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS r(i)
  WHERE trim(parts[i]) <> '')""" + LINE_MATCH_SQL)
def best_line_match(spark, folder):
    return X.best_line_match(document_lines(spark, folder))


@query("best_turn_match", f"""WITH lines AS (SELECT CAST(conv_id AS VARCHAR) AS chapter, turn AS line_no,
    {ONE_BYTE.format("text")} AS line FROM conversations)""" + LINE_MATCH_SQL)
def best_turn_match(spark, folder):
    return X.best_line_match(conversation_lines(spark, folder))


@query("levenshtein_similarity", """WITH p AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part)
SELECT p_partkey, CAST(greatest(length(a), length(b)) - levenshtein(a, b) AS DOUBLE) / greatest(length(a), length(b)) AS similarity FROM p""")
def levenshtein_similarity(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", T.levenshtein_similarity(F.col("p_name"), F.col("p_type")).alias("similarity"))


@query("regularize_word", """SELECT p_partkey, regexp_replace(upper(trim(p_brand || ' ' || p_name)), '[^A-Z]', '', 'g') AS word FROM part""")
def regularize_word(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", T.regularize_word(F.concat_ws(" ", "p_brand", "p_name")).alias("word"))


@query("sorted_letters", """SELECT p_partkey, array_to_string(list_sort(string_split(p_name, '')), '') AS letters FROM part""")
def sorted_letters(spark, folder):
    return table(spark, folder, "part").select("p_partkey", T.sorted_letters(F.col("p_name")).alias("letters"))


def _emit_words(batches):
    for batch in batches:
        found = [w for text in batch["text"].fillna("") for w in regex.findall(r"\p{L}+", text.upper())]
        yield pd.DataFrame({"word": pd.Series(found, dtype=str), "n": 1})


def _combine(batch: pd.DataFrame) -> pd.DataFrame:
    return batch.groupby("word", as_index=False)["n"].sum()


def _sum_words(key, batches):
    yield pd.DataFrame({"word": [key[0]], "n": [sum(int(b["n"].sum()) for b in batches)]})


@query("map_reduce", """SELECT word, count(*) AS n FROM (
  SELECT """ + LETTERS_SQL + """ AS word FROM conversations) GROUP BY word""")
def map_reduce(spark, folder):
    talk = table(spark, folder, "conversations").select("text")
    return MR.map_reduce(talk, _emit_words, "word string, n long", ["word"], _sum_words,
                         "word string, n long", combiner=_combine)


@query("chain", """SELECT n, count(*) AS n_words FROM (SELECT word, count(*) AS n FROM (
  SELECT """ + LETTERS_SQL + """ AS word FROM conversations) GROUP BY word) GROUP BY n""")
def chain(spark, folder):
    """Two jobs, the second fed by the first."""
    talk = table(spark, folder, "conversations").select("text")
    return MR.chain(
        talk,
        lambda df: df.select(F.explode(F.regexp_extract_all(
            F.upper("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).groupBy("word").agg(
            F.count(F.lit(1)).alias("n")),
        lambda df: df.groupBy("n").agg(F.count(F.lit(1)).alias("n_words")))


@query("map_rows", """SELECT """ + LETTERS_SQL + """ AS word, CAST(1 AS BIGINT) AS n FROM benchmark""")
def map_rows(spark, folder):
    return MR.map_rows(table(spark, folder, "benchmark").select("text"), _emit_words, "word string, n long")


@query("streaming_word_count", WORDS_SQL.format(source="conversations") + "SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word")
def streaming_word_count(spark, folder):
    """The word count on a stream of files that stops and goes on: counts are read from the files it wrote."""
    from specengine.streaming.words import latest_counts, running_word_count, stream_parquet

    source, out, progress = (scratch_path(spark, n) for n in ("talk", "counts", "progress"))
    talk = table(spark, folder, "conversations").select("conv_id", "text")
    for part in (0, 1):  # the second half arrives after a restart
        talk.filter(F.pmod("conv_id", F.lit(2)) == part).select("text").repartition(2).write.mode("append").parquet(source)
        running = running_word_count(stream_parquet(spark, source, "text string"), out, progress)
        running.processAllAvailable()
        running.stop()
    return latest_counts(spark, out)
