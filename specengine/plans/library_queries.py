"""Queries over proteins, peptides and the peptide library."""

from __future__ import annotations

from pyspark.sql import functions as F

from specengine.functions import masses as M
from specengine.functions import peptide as P
from specengine.operators import digest as D
from specengine.operators import filters as X
from specengine.operators import library as L
from specengine.operators import mods as MO
from specengine.plans.registry import query
from specengine.plans.tables import ctes, proteins, residue_sql, table
from specengine.session import scratch_path
from specengine.sinks import files as S

USABLE = "regexp_matches(sequence, '^[ACDEFGHIKLMNPQRSTVWY]{4,40}$')"
DIGEST_SQL = ctes("proteins", "pieces", "peptides")
MISSED_SQL = ctes("proteins", "pieces", f"""missed AS (
  SELECT protein, k AS missed_cleavages, array_to_string(parts[i:i + k], '') AS sequence
  FROM pieces, unnest([0, 1, 2]) AS m(k) WHERE i + k <= len(parts)),
peptides AS (SELECT * FROM missed WHERE {USABLE})""")


def _unique_sql(mass_type: str = "mono") -> str:
    """Distinct peptides with exact masses."""
    return ctes("proteins", "pieces", "peptides", f"""lib AS (
  SELECT sequence, nano, nano / 1000000000.0e0 AS mass,
         (nano + {M.MATCHING_OFFSET_NANO}) / 1000000000.0e0 AS matching_mass
  FROM (SELECT sequence, {residue_sql('sequence', mass_type)} AS nano
        FROM (SELECT DISTINCT sequence FROM peptides)))""")


def unique_peptides(spark, folder):
    """Distinct usable peptides with masses."""
    return L.add_masses(D.digest(proteins(spark, folder)).select("sequence").distinct()).withColumn(
        "mod_sequence", F.col("sequence"))


def documents_as_annotations(spark, folder):
    doc = F.col("doc_id").cast("string")
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("pos"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("sp|D"), doc, F.lit("|"), "source"))
        .when(F.col("doc_id") % 3 == 1, F.concat_ws(" ", "source", "lang"))
        .otherwise(F.concat(F.col("lang"), F.lit("-"), F.col("source"), F.lit(":x "), doc))
        .alias("annotation"))


ANNOTATIONS_SQL = """WITH ann AS (
  SELECT doc_id AS pos, CASE WHEN doc_id % 3 = 0 THEN 'sp|D' || doc_id || '|' || source
    WHEN doc_id % 3 = 1 THEN source || ' ' || lang
    ELSE lang || '-' || source || ':x ' || doc_id END AS annotation
  FROM documents)
"""


@query("protein_id", ANNOTATIONS_SQL + """
SELECT pos, CASE WHEN regexp_matches(annotation, '^>?sp[|][^|]*[|]') THEN string_split(annotation, '|')[2]
  ELSE regexp_replace(regexp_replace(upper(string_split(regexp_replace(trim(annotation), '^>', ''), ' ')[1]),
         '^[^\\p{L}\\p{Nd}]+', ''), '[^\\p{L}\\p{Nd}]', '_', 'g') END AS protein_id
FROM ann""")
def protein_id(spark, folder):
    return documents_as_annotations(spark, folder).select(
        "pos", P.protein_id(F.col("annotation")).alias("protein_id"))


@query("annotation_ids", ANNOTATIONS_SQL + """
SELECT annotation, min(pos) AS first_pos,
       CAST(row_number() OVER (ORDER BY min(pos), annotation) AS BIGINT) AS id
FROM ann GROUP BY annotation""")
def annotation_ids(spark, folder):
    return L.annotation_ids(documents_as_annotations(spark, folder)).select(
        "annotation", "first_pos", "id")


@query("condition_protein_label", """
SELECT doc_id, md5(label) AS label_md5, CAST(length(label) AS INTEGER) AS n
FROM (SELECT doc_id, regexp_replace(replace(regexp_replace(text, '[^ -~]', '', 'g'), '|', '_'),
      '["''!;:,]', ' ', 'g') AS label FROM documents)""")
def condition_protein_label(spark, folder):
    label = P.condition_protein_label(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", label.alias("l")).select(
        "doc_id", F.md5("l").alias("label_md5"), F.length("l").alias("n"))


@query("decoy_label", """WITH l AS (
  SELECT c_custkey, ['REV_', 'RND_', '###REV###', 'REV1_', '', 'DECOY_'][1 + c_custkey % 6] || c_name AS label
  FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 6 = 4 THEN NULL
  ELSE 'DECOY_' || regexp_replace(label, '^(###REV###|###RND###|RND_|REV_|REV1_|DECOY_)', '') END AS decoy
FROM l""")
def decoy_label(spark, folder):
    prefixes = F.array(*[F.lit(x) for x in ("REV_", "RND_", "###REV###", "REV1_", "", "DECOY_")])
    return table(spark, folder, "customer").select("c_custkey", P.decoy_label(F.concat(
        F.get(prefixes, (F.col("c_custkey") % 6).cast("int")), F.col("c_name"))).alias("decoy"))


@query("digest", DIGEST_SQL + """
SELECT protein, count(*) AS n, CAST(sum(length(sequence)) AS BIGINT) AS residues,
       min(sequence) AS least, max(sequence) AS greatest
FROM peptides GROUP BY protein""")
def digest(spark, folder):
    return D.digest(proteins(spark, folder)).groupBy("protein").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("sequence")).alias("residues"),
        F.min("sequence").alias("least"), F.max("sequence").alias("greatest"))


@query("digest_lysc", ctes("proteins", f"""parts AS (
  SELECT protein, unnest(list_filter(string_split(replace(sequence, 'K', 'K|'), '|'),
         lambda x: x <> '')) AS sequence FROM proteins)""") + f"""
SELECT sequence, count(*) AS n FROM parts WHERE {USABLE} GROUP BY sequence""")
def digest_lysc(spark, folder):
    return D.digest(proteins(spark, folder), "lysc").groupBy("sequence").agg(
        F.count(F.lit(1)).alias("n"))


@query("missed_cleavages", MISSED_SQL + """
SELECT protein, count(*) AS n, CAST(sum(length(sequence)) AS BIGINT) AS residues,
       min(sequence) AS least, max(sequence) AS greatest
FROM (SELECT DISTINCT protein, sequence FROM peptides) GROUP BY protein""")
def missed_cleavages(spark, folder):
    return D.missed_cleavages(proteins(spark, folder), 2).groupBy("protein").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("sequence")).alias("residues"),
        F.min("sequence").alias("least"), F.max("sequence").alias("greatest"))


@query("semi_cleavages", ctes("proteins", "pieces", f"""ends AS (
  SELECT protein, sequence FROM pieces
  UNION ALL SELECT protein, substr(sequence, 1, n) FROM pieces, unnest(range(1, length(sequence))) AS u(n)
  UNION ALL SELECT protein, substr(sequence, n + 1) FROM pieces, unnest(range(1, length(sequence))) AS u(n)),
peptides AS (SELECT DISTINCT protein, sequence FROM ends WHERE {USABLE})""") + """
SELECT protein, count(*) AS n, CAST(sum(length(sequence)) AS BIGINT) AS residues,
       min(sequence) AS least, max(sequence) AS greatest
FROM peptides GROUP BY protein""")
def semi_cleavages(spark, folder):
    return D.semi_cleavages(proteins(spark, folder)).groupBy("protein").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("sequence")).alias("residues"),
        F.min("sequence").alias("least"), F.max("sequence").alias("greatest"))


@query("count_missed", MISSED_SQL + """
SELECT missed_cleavages, CAST(
  len(regexp_extract_all(replace(replace(left(sequence, length(sequence) - 1), 'KP', '--'), 'RP', '--'), '[KR]'))
  - CASE WHEN right(sequence, 1) = 'P' AND substr(sequence, length(sequence) - 1, 1) IN ('K', 'R')
    THEN 1 ELSE 0 END AS INTEGER) AS counted, count(*) AS n
FROM peptides GROUP BY 1, 2""")
def count_missed(spark, folder):
    return D.digest(proteins(spark, folder), missed=2).groupBy(
        "missed_cleavages", D.count_missed(F.col("sequence")).alias("counted")).agg(
        F.count(F.lit(1)).alias("n"))


@query("peptide_positions", ctes("proteins", "pieces", f"""placed AS (
  SELECT protein, i, parts, sequence,
    sum(length(sequence)) OVER (PARTITION BY protein ORDER BY i) - length(sequence) AS start
  FROM pieces),
missed AS (
  SELECT protein, k, start, array_to_string(parts[i:i + k], '') AS sequence,
    CASE WHEN i = 1 THEN '-' ELSE right(parts[i - 1], 1) END AS before,
    CASE WHEN i + k = len(parts) THEN '-' ELSE left(parts[i + k + 1], 1) END AS after
  FROM placed, unnest([0, 1]) AS m(k) WHERE i + k <= len(parts))""") + f"""
SELECT protein, before, after, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts,
       CAST(max(start) AS INTEGER) AS last_start
FROM missed WHERE {USABLE} GROUP BY protein, before, after""")
def peptide_positions(spark, folder):
    return D.digest(proteins(spark, folder), missed=1, positions=True).groupBy(
        "protein", "before", "after").agg(
        F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"),
        F.max("start").alias("last_start"))


@query("usable_peptide", ctes("proteins", "pieces") + f"""
SELECT CAST(length(sequence) AS INTEGER) AS length, {USABLE} AS usable, count(*) AS n
FROM pieces GROUP BY 1, 2""")
def usable_peptide(spark, folder):
    pieces = D.digest(proteins(spark, folder), usable=False)
    return pieces.groupBy(F.length("sequence").alias("length"),
                          P.usable_peptide(F.col("sequence")).alias("usable")).agg(
        F.count(F.lit(1)).alias("n"))


@query("valid_sequence", """WITH s AS (
  SELECT doc_id, upper(regexp_replace(w, '[^A-Za-z]', '', 'g')) AS w
  FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents))
SELECT doc_id, CAST(count_if(regexp_matches(w, '^[ACDEFGHIKLMNPQRSTVWYBZ]+$')) AS BIGINT) AS n_valid,
       CAST(count_if(regexp_matches(w, '^[ACDEFGHIKLMNPQRSTVWY]+$')) AS BIGINT) AS n_unambiguous,
       CAST(count_if(NOT regexp_matches(w, '[RK]$')) AS BIGINT) AS n_semi
FROM s GROUP BY doc_id""")
def valid_sequence(spark, folder):
    words = table(spark, folder, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    w = F.upper(F.regexp_replace("w", "[^A-Za-z]", ""))
    return words.select("doc_id", w.alias("w")).groupBy("doc_id").agg(
        F.count_if(P.valid_sequence(F.col("w"))).alias("n_valid"),
        F.count_if(P.unambiguous_sequence(F.col("w"))).alias("n_unambiguous"),
        F.count_if(P.probably_semi_tryptic(F.col("w"))).alias("n_semi"))


@query("probably_semi_tryptic", DIGEST_SQL + """
SELECT right(sequence, 1) NOT IN ('R', 'K') AS semi, count(*) AS n, min(sequence) AS least
FROM peptides GROUP BY 1""")
def probably_semi_tryptic(spark, folder):
    return D.digest(proteins(spark, folder)).groupBy(
        P.probably_semi_tryptic(F.col("sequence")).alias("semi")).agg(
        F.count(F.lit(1)).alias("n"), F.min("sequence").alias("least"))


@query("aa_count", ctes("proteins") + """
SELECT protein, CAST(length(sequence) - length(replace(sequence, 'K', '')) AS INTEGER) AS n_k,
       CAST(length(sequence) - length(replace(sequence, 'R', '')) AS INTEGER) AS n_r
FROM proteins""")
def aa_count(spark, folder):
    return proteins(spark, folder).select(
        "protein", P.aa_count(F.col("sequence"), "K").alias("n_k"),
        P.aa_count(F.col("sequence"), "R").alias("n_r"))


@query("peptide_mass", _unique_sql().rstrip() + f"""
SELECT sequence, mass, matching_mass, {residue_sql('sequence', 'average')} / 1000000000.0e0 AS average_mass
FROM lib""")
def peptide_mass(spark, folder):
    return unique_peptides(spark, folder).select(
        "sequence", "mass", "matching_mass",
        M.peptide_mass(F.col("sequence"), "average").alias("average_mass"))


@query("formula_mass", f"""
SELECT p_partkey, 'C' || p_size || 'H' || (2 * p_size + 1) || 'ON' || (1 + p_partkey % 13) || 'S' AS formula,
  (p_size * 12000000000::BIGINT + (2 * p_size + 1) * {M.to_nano('1.007825035')}::BIGINT
   + {M.to_nano('15.99491463')}::BIGINT + (1 + p_partkey % 13) * {M.to_nano('14.003074')}::BIGINT
   + {M.to_nano('31.9720707')}::BIGINT) / 1000000000.0e0 AS mass
FROM part""")
def formula_mass(spark, folder):
    size = F.col("p_size").cast("string")
    formula = F.concat(F.lit("C"), size, F.lit("H"), (2 * F.col("p_size") + 1).cast("string"),
                       F.lit("ON"), (1 + F.col("p_partkey") % 13).cast("string"), F.lit("S"))
    return table(spark, folder, "part").select("p_partkey", formula.alias("formula")).withColumn(
        "mass", M.formula_mass(F.col("formula")))


@query("matching_mass", """
SELECT p_partkey, p_retailprice + 17.002735e0 + 1.007276e0 + 1.007276e0 AS matching_mass,
       round(p_retailprice - 17.002735e0 - 1.007276e0 - 1.007276e0, 6) AS mass
FROM part""")
def matching_mass(spark, folder):
    price = F.col("p_retailprice")
    return table(spark, folder, "part").select(
        "p_partkey", M.matching_mass(price).alias("matching_mass"),
        F.round(M.mass_from_matching(price), 6).alias("mass"))


# ---- modifications ----------------------------------------------------------

OXIDATION = MO.parse_mods("15.9949@M")
MODS = MO.parse_mods("15.9949@M,79.9663@Y")


def _mods_sql() -> str:
    nh3, h2o = M.formula_nano("NH3"), M.formula_nano("H2O")
    return ctes("proteins", "pieces", "peptides", f"""u AS MATERIALIZED (SELECT DISTINCT sequence FROM peptides),
sites AS MATERIALIZED (
  SELECT sequence, CAST(p AS INTEGER) AS pos, CASE substr(sequence, p, 1) WHEN 'M' THEN 15994900000 ELSE 79966300000 END AS nano,
         CASE substr(sequence, p, 1) WHEN 'M' THEN '15.995' ELSE '79.966' END AS label
  FROM u, unnest(range(1, length(sequence) + 1)) AS r(p)
  WHERE substr(sequence, p, 1) IN ('M', 'Y')
  UNION ALL
  SELECT sequence, 1, CASE WHEN left(sequence, 1) IN ('Q', 'C') THEN -{nh3} ELSE -{h2o} END,
         CASE WHEN left(sequence, 1) IN ('Q', 'C') THEN '{-nh3 / 1e9:.3f}' ELSE '{-h2o / 1e9:.3f}' END
  FROM u WHERE left(sequence, 1) IN ('Q', 'C', 'E')),
variants AS (
  SELECT sequence, sequence AS mod_sequence, 0 AS n_mods, 0::BIGINT AS nano FROM u
  UNION ALL
  SELECT sequence, substr(sequence, 1, pos) || '[' || label || ']' || substr(sequence, pos + 1), 1, nano FROM sites
  UNION ALL
  SELECT a.sequence, substr(a.sequence, 1, a.pos) || '[' || a.label || ']' || substr(a.sequence, a.pos + 1, b.pos - a.pos)
         || '[' || b.label || ']' || substr(a.sequence, b.pos + 1), 2, a.nano + b.nano
  FROM sites a JOIN sites b ON a.sequence = b.sequence AND a.pos < b.pos)""")


def variants(spark, folder):
    return MO.apply_mods(unique_peptides(spark, folder).select("sequence"), MODS, 2)


@query("apply_mods", _mods_sql() + """
SELECT n_mods, CAST(length(sequence) AS INTEGER) AS length, count(*) AS n, CAST(sum(nano) AS BIGINT) AS nano,
       min(mod_sequence) AS least, max(mod_sequence) AS greatest
FROM variants GROUP BY 1, 2""")
def apply_mods(spark, folder):
    return variants(spark, folder).groupBy(
        F.size("mods").alias("n_mods"), F.length("sequence").alias("length")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(MO.mods_nano(F.col("mods"))).alias("nano"),
        F.min("mod_sequence").alias("least"), F.max("mod_sequence").alias("greatest"))


@query("format_mod_sequence", _mods_sql() + """
SELECT mod_sequence, CAST(n_mods AS INTEGER) AS n_mods FROM variants WHERE n_mods = 2""")
def format_mod_sequence(spark, folder):
    return variants(spark, folder).select(
        "mod_sequence", F.size("mods").alias("n_mods")).filter(F.col("n_mods") == 2)


@query("parse_mod_sequence", _mods_sql() + """
SELECT sequence, count(*) AS n, CAST(sum(n_mods) AS BIGINT) AS n_mods
FROM variants WHERE n_mods > 0 GROUP BY sequence""")
def parse_mod_sequence(spark, folder):
    text = F.col("mod_sequence")
    parsed = variants(spark, folder).filter(F.size("mods") > 0).select(
        P.plain_sequence(text).alias("sequence"), P.parse_mod_sequence(text).alias("m"))
    return parsed.groupBy("sequence").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("m")).alias("n_mods"))


@query("distinct_variants", _mods_sql() + """
SELECT CAST(length(mod_sequence) AS INTEGER) AS length, count(DISTINCT mod_sequence) AS n
FROM variants GROUP BY 1""")
def distinct_variants(spark, folder):
    from specengine.operators.sets import distinct_variants as op

    return op(variants(spark, folder)).groupBy(F.length("mod_sequence").alias("length")).agg(
        F.count(F.lit(1)).alias("n"))


@query("mods_compatible", _mods_sql() + """
SELECT CAST(length(sequence) AS INTEGER) AS length, count(*) AS n
FROM variants
WHERE NOT regexp_matches(left(mod_sequence, length(mod_sequence)), '^.+Y\\[79\\.966\\].')
   OR regexp_matches(mod_sequence, '^[A-Z](\\[[^\\]]*\\])?([A-XZ](\\[[^\\]]*\\])?|Y)*(Y\\[79\\.966\\])?$')
GROUP BY 1""")
def mods_compatible(spark, folder):
    kept = MO.mods_compatible(F.col("mods"), F.length("sequence"), [("M", "15.995")])
    return variants(spark, folder).filter(kept).groupBy(F.length("sequence").alias("length")).agg(
        F.count(F.lit(1)).alias("n"))


# ---- decoys, duplicates, counts -----------------------------------------------

@query("reverse_decoys", DIGEST_SQL + """, d AS (
  SELECT protein, sequence, false AS is_decoy FROM peptides
  UNION ALL SELECT 'DECOY_' || protein, reverse(sequence), true FROM peptides)
SELECT is_decoy, sequence, count(*) AS n, min(protein) AS protein FROM d GROUP BY 1, 2""".replace(
    "\n, d AS", ", d AS"))
def reverse_decoys(spark, folder):
    return L.reverse_decoys(D.digest(proteins(spark, folder))).groupBy(
        "is_decoy", "sequence").agg(
        F.count(F.lit(1)).alias("n"), F.min("protein").alias("protein"))


DECOY_SQL = ctes("proteins", """targets AS (SELECT * FROM proteins),
both_ AS (
  SELECT protein, sequence, false AS is_decoy FROM targets
  UNION ALL SELECT 'DECOY_' || protein, reverse(sequence), true FROM targets)""")
DECOY_PEPTIDES_SQL = DECOY_SQL.rstrip() + f""",
cut AS (
  SELECT protein, is_decoy, unnest(list_filter(string_split(replace(replace(replace(replace(replace(replace(
    sequence, 'KP', '1'), 'RP', '2'), 'K', 'K|'), 'R', 'R|'), '1', 'KP'), '2', 'RP'), '|'),
    lambda x: x <> '')) AS sequence
  FROM both_),
peptides AS (SELECT * FROM cut WHERE {USABLE})
"""


@query("reverse_protein_decoys", DECOY_SQL + """
SELECT protein, is_decoy, md5(sequence) AS sequence_md5 FROM both_""")
def reverse_protein_decoys(spark, folder):
    return L.reverse_protein_decoys(proteins(spark, folder)).select(
        "protein", "is_decoy", F.md5("sequence").alias("sequence_md5"))


@query("dedupe_peptides", DIGEST_SQL + """
SELECT sequence, count(DISTINCT protein) AS n_proteins, count(*) AS n_positions, min(protein) AS first_protein
FROM peptides GROUP BY sequence""")
def dedupe_peptides(spark, folder):
    return L.dedupe_peptides(D.digest(proteins(spark, folder))).select(
        "sequence", "n_proteins", "n_positions", "first_protein")


@query("peptide_proteins", DIGEST_SQL + """
SELECT protein, count(DISTINCT sequence) AS n_peptides FROM peptides GROUP BY protein""")
def peptide_proteins(spark, folder):
    return L.peptide_proteins(D.digest(proteins(spark, folder))).groupBy("protein").agg(
        F.count(F.lit(1)).alias("n_peptides"))


@query("target_decoy_class", DECOY_PEPTIDES_SQL + """
SELECT validity, count(*) AS n, min(sequence) AS least FROM (
  SELECT sequence, CASE WHEN bool_or(is_decoy) AND bool_or(NOT is_decoy) THEN 'Real_and_Decoy'
    WHEN bool_or(is_decoy) THEN 'Decoy' ELSE 'Real' END AS validity
  FROM peptides GROUP BY sequence) GROUP BY validity""")
def target_decoy_class(spark, folder):
    both = L.reverse_protein_decoys(proteins(spark, folder))
    return L.dedupe_peptides(D.digest(both)).groupBy("validity").agg(
        F.count(F.lit(1)).alias("n"), F.min("sequence").alias("least"))


@query("parser_counts", DECOY_PEPTIDES_SQL + """
SELECT 'proteins' AS name, count(*) AS value FROM both_
UNION ALL SELECT 'decoy_proteins', CAST(count_if(is_decoy) AS BIGINT) FROM both_
UNION ALL SELECT 'amino_acids', CAST(sum(length(sequence)) AS BIGINT) FROM both_
UNION ALL SELECT 'fragments', count(*) FROM peptides
UNION ALL SELECT 'unique_fragments', count(DISTINCT sequence) FROM peptides""")
def parser_counts(spark, folder):
    both = L.reverse_protein_decoys(proteins(spark, folder))
    return L.parser_counts(both, D.digest(both))


@query("duplicate_histogram", DIGEST_SQL + """
SELECT n_proteins, count(*) AS n_peptides
FROM (SELECT sequence, count(DISTINCT protein) AS n_proteins FROM peptides GROUP BY sequence)
GROUP BY n_proteins""")
def duplicate_histogram(spark, folder):
    return L.duplicate_histogram(D.digest(proteins(spark, folder)))


# ---- bins, sizes, lookups --------------------------------------------------------

@query("mass_to_bins", _unique_sql() + """
SELECT bin, count(*) AS n FROM (
  SELECT unnest(list_distinct([(nano - 20000000) // 100000000, nano // 100000000, (nano + 20000000) // 100000000])) AS bin
  FROM lib) GROUP BY bin""")
def mass_to_bins(spark, folder):
    return L.mass_to_bins(unique_peptides(spark, folder), 0.1, 0.02).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"))


@query("bin_counts", _mods_sql() + f""", v AS (
  SELECT n_mods, nano + {residue_sql('sequence')} AS nano FROM variants)
SELECT nano // 100000000 AS bin, count(*) AS n_peptides, CAST(count_if(n_mods > 0) AS BIGINT) AS n_modified
FROM v GROUP BY 1""")
def bin_counts(spark, folder):
    made = MO.apply_mods(unique_peptides(spark, folder).select("sequence", "nano"), MODS, 2)
    binned = L.add_masses(made, residues="nano").withColumn("bin", L.mass_bin(F.col("nano")))
    return L.bin_counts(binned)


@query("bin_sections", _unique_sql() + """
SELECT bin, section, count(*) AS n, min(sequence) AS least, max(sequence) AS greatest FROM (
  SELECT nano // 100000000 AS bin, sequence,
    CAST((row_number() OVER (PARTITION BY nano // 100000000 ORDER BY sequence) - 1) // 5 AS BIGINT) AS section
  FROM lib) GROUP BY 1, 2""")
def bin_sections(spark, folder):
    binned = unique_peptides(spark, folder).withColumn("bin", L.mass_bin(F.col("nano")))
    return L.bin_sections(binned, rows=5).groupBy("bin", "section").agg(
        F.count(F.lit(1)).alias("n"), F.min("sequence").alias("least"),
        F.max("sequence").alias("greatest"))


@query("db_sizes", _unique_sql() + """
SELECT CAST(floor(matching_mass) AS INTEGER) AS mass_int, count(*) AS n FROM lib GROUP BY 1""")
def db_sizes(spark, folder):
    return L.db_sizes(unique_peptides(spark, folder))


@query("write_db_sizes", _unique_sql() + """
SELECT CAST(floor(matching_mass) AS INTEGER) AS mass_int, count(*) AS n FROM lib GROUP BY 1""")
def write_db_sizes(spark, folder):
    path = scratch_path(spark, "sizes")
    S.write_db_sizes(unique_peptides(spark, folder), path)
    return S.read_db_sizes(spark, path)


@query("peptides_of_mass", _unique_sql() + """
SELECT sequence, mass FROM lib WHERE floor(matching_mass) = 1500""")
def peptides_of_mass(spark, folder):
    path = scratch_path(spark, "library")
    S.write_peptide_db(unique_peptides(spark, folder), path)
    return S.peptides_of_mass(spark, path, 1500).select("sequence", "mass")


@query("guarantee_peptide_db", _unique_sql() + """
SELECT CAST(floor(matching_mass) AS INTEGER) AS mass_int, count(*) AS n, max(sequence) AS greatest
FROM lib GROUP BY 1""")
def guarantee_peptide_db(spark, folder):
    path = scratch_path(spark, "library")
    peptides = unique_peptides(spark, folder)
    S.guarantee_peptide_db(peptides, path)
    S.guarantee_peptide_db(peptides.filter(F.lit(False)), path)
    return S.read_peptide_db(spark, path).groupBy("mass_int").agg(
        F.count(F.lit(1)).alias("n"), F.max("sequence").alias("greatest"))


@query("write_peptides_by_mass", DIGEST_SQL.rstrip() + f""", lib AS (
  SELECT sequence, min(protein) AS first_protein, count(DISTINCT protein) AS n_proteins,
         {residue_sql('sequence')} AS nano FROM peptides GROUP BY sequence)
SELECT CAST((nano + {M.MATCHING_OFFSET_NANO}) // 1000000000 AS INTEGER) AS mass_int, sequence AS mod_sequence,
       nano / 1000000000.0e0 AS mass, first_protein, n_proteins
FROM lib""")
def write_peptides_by_mass(spark, folder):
    path = scratch_path(spark, "bymass")
    S.write_peptides_by_mass(L.build_library(proteins(spark, folder)), path)
    return spark.read.schema(
        "mod_sequence string, mass double, mass_int int, first_protein string, n_proteins long"
    ).csv(path).drop("mass_band")


@query("peptides_within_limits", _unique_sql() + """
SELECT sequence, mass FROM lib WHERE matching_mass BETWEEN 1500.0 - 2.1 AND 1500.0 + 4.1""")
def peptides_within_limits(spark, folder):
    return L.peptides_within(unique_peptides(spark, folder), 1500.0, 2.1, 4.1).select(
        "sequence", "mass")


@query("peptide_interval", _unique_sql() + """
SELECT mass_int, sequence FROM (
  SELECT CAST(floor(matching_mass) AS INTEGER) AS mass_int, sequence,
    row_number() OVER (PARTITION BY floor(matching_mass) ORDER BY sequence) - 1 AS place FROM lib)
WHERE place >= 3 AND place < 8""")
def peptide_interval(spark, folder):
    return L.peptide_interval(unique_peptides(spark, folder), 3, 8).select("mass_int", "sequence")


@query("fasta_statistics", DIGEST_SQL + f"""
SELECT 'protein_length' AS what, CAST(length(sequence) // 100 * 100 AS BIGINT) AS bin, count(*) AS n
FROM proteins GROUP BY 2
UNION ALL SELECT 'fragment_length', length(sequence), count(*) FROM peptides GROUP BY 2
UNION ALL SELECT 'mono_mass', {residue_sql('sequence')} // 1000000000, count(*) FROM peptides GROUP BY 2
UNION ALL SELECT 'average_mass', {residue_sql('sequence', 'average')} // 1000000000, count(*)
FROM peptides GROUP BY 2""")
def fasta_statistics(spark, folder):
    return L.fasta_statistics(proteins(spark, folder))


@query("fragments_by_mass_tables", _unique_sql() + """
SELECT CAST(nano // 1000000000 AS INTEGER) AS mass_int, sequence, mass FROM lib""")
def fragments_by_mass_tables(spark, folder):
    return L.mass_index_table(L.add_masses(D.digest(proteins(spark, folder))))


@query("sequence_seen", ctes("proteins") + """
SELECT protein, sequence_md5, row_number() OVER (PARTITION BY sequence_md5 ORDER BY pos) > 1 AS seen
FROM (SELECT protein, md5(sequence) AS sequence_md5, CAST(substr(protein, 2) AS BIGINT) AS pos FROM proteins)""")
def sequence_seen(spark, folder):
    placed = proteins(spark, folder).withColumn(
        "pos", F.substring("protein", 2, 20).cast("long"))
    return L.sequence_seen(placed).select("protein", F.md5("sequence").alias("sequence_md5"), "seen")


@query("build_library", DECOY_PEPTIDES_SQL.replace(", lib AS", ", lib_ AS").rstrip() + f""",
u AS (SELECT sequence, bool_or(is_decoy) AS d, bool_or(NOT is_decoy) AS t FROM peptides GROUP BY sequence),
sites AS (
  SELECT sequence, CAST(p AS INTEGER) AS pos FROM u, unnest(range(1, length(sequence) + 1)) AS r(p)
  WHERE substr(sequence, p, 1) = 'M'),
ends AS (
  SELECT sequence, 1 AS pos, CASE WHEN left(sequence, 1) = 'E' THEN -{M.formula_nano('H2O')} ELSE -{M.formula_nano('NH3')} END AS nano
  FROM u WHERE left(sequence, 1) IN ('Q', 'C', 'E')),
places AS (SELECT sequence, pos, 15994900000 AS nano FROM sites UNION ALL SELECT * FROM ends),
v AS (
  SELECT sequence, 0::BIGINT AS nano FROM u
  UNION ALL SELECT sequence, nano FROM places
  UNION ALL SELECT a.sequence, a.nano + b.nano FROM places a JOIN places b
    ON a.sequence = b.sequence AND a.pos < b.pos)
SELECT CASE WHEN d AND t THEN 'Real_and_Decoy' WHEN d THEN 'Decoy' ELSE 'Real' END AS validity,
  (v.nano + {residue_sql('u.sequence')}) // 10000000000 AS bin, count(*) AS n
FROM v JOIN u ON v.sequence = u.sequence GROUP BY 1, 2""")
def build_library(spark, folder):
    library = L.build_library(proteins(spark, folder), mods=OXIDATION, decoys=True)
    return library.groupBy("validity", L.mass_bin(F.col("nano"), 10.0).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


@query("is_db_rebuild_required", """
SELECT 'same' AS settings, false AS rebuild UNION ALL SELECT 'other_rule', true
UNION ALL SELECT 'missing', true""")
def is_db_rebuild_required(spark, folder):
    params, sizes = scratch_path(spark, "params"), scratch_path(spark, "sizes")
    S.write_digester_params(spark, params, "trypsin", 0, False, False, ["15.9949@M"])
    S.write_db_sizes(unique_peptides(spark, folder), sizes)
    check = lambda path, rule: S.is_db_rebuild_required(
        spark, path, sizes, rule, 0, False, False, ["15.9949@M"])
    return spark.createDataFrame(
        [("same", check(params, "trypsin")), ("other_rule", check(params, "lysc")),
         ("missing", check(params + "-none", "trypsin"))], "settings string, rebuild boolean")


# ---- protein selections ------------------------------------------------------------

@query("select_proteins_by_prefix", """WITH a AS (
  SELECT DISTINCT source || ' ' || lang || ' ' || doc_id AS annotation FROM documents),
ids AS (SELECT DISTINCT 'src' || s_nationkey AS prefix FROM supplier)
SELECT annotation FROM a WHERE EXISTS (SELECT 1 FROM ids WHERE starts_with(annotation, prefix))""")
def select_proteins_by_prefix(spark, folder):
    annotated = table(spark, folder, "documents").select(
        F.concat_ws(" ", "source", "lang", F.col("doc_id").cast("string")).alias("annotation"))
    ids = table(spark, folder, "supplier").select(
        F.concat(F.lit("src"), F.col("s_nationkey").cast("string")).alias("prefix"))
    return X.select_proteins_by_prefix(annotated, ids).select("annotation")


@query("select_proteins_containing", ctes("proteins", """listed AS (
  SELECT DISTINCT regexp_replace(upper(word), '[^A-Z]|[BJOUXZ]', '', 'g') AS peptide
  FROM (SELECT unnest(string_split(text, ' ')) AS word FROM benchmark))""") + """
SELECT protein FROM proteins
WHERE EXISTS (SELECT 1 FROM listed WHERE peptide <> '' AND contains(sequence, peptide))""")
def select_proteins_containing(spark, folder):
    word = F.explode(F.split("text", " "))
    listed = table(spark, folder, "benchmark").select(word.alias("word")).select(
        F.regexp_replace(F.upper("word"), "[^A-Z]|[BJOUXZ]", "").alias("sequence"))
    return X.select_proteins_containing(proteins(spark, folder), listed).select("protein")
