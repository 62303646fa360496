"""Registered queries against their SQL on the smallest tables.

Quick ones by default; SPECENGINE_ALL_QUERIES=1 runs every one.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare

QUICK = """protein_id annotation_ids decoy_label digest missed_cleavages peptide_mass formula_mass dedupe_peptides
target_decoy_class parser_counts bin_sections db_sizes peptide_interval select_proteins_by_prefix remove_isotopes
remove_parent normalize_dynamic_range clean_isotopes top_n_peaks condition_spectra sliding_mean_subtract
comet_bin_weights guess_charge fdr_bin bin_charge_join within_limits peak_match_join pair_counts search_kscore
fdr_counts fdr_at_score filtered_fdr protein_hits roc_points statistics linear_fit compare_results comparison_summary
nofk_filter index_by_order group_values word_count word_stats map_reduce read_fasta read_mgf read_mzml read_msp
streaming_word_count write_protein_tsv""".split()
NAMES = list(entry.queries()) if os.environ.get("SPECENGINE_ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, folder, name):
    status, note, _, _ = compare(spark, con, folder, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert status in ("ok", "rows"), note


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
