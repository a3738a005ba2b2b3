"""Every registered query with a SQL twin gives the same rows as DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, normal

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

# A cross-section by default; FULL_ORACLE=1 runs every query (check.py does so too, at any scale).
CORE = """tpm_top_features symbol_rollup mapping_ambiguity size_factors bh_adjust filter_grid weighted_bh volcano_table fc_tiers
marker_specificity high_abundance_anchor evidence_matrix describe_long linear_fit rank_sum pairwise_distance reconcile_ids_first
annotate_many merge_sources source_diff reference_and_rank set_overlap ranked_enrichment set_edges simplify_graph markov_rounds
node_annotation cluster_profile parse_encoded clean_measurements relative_abundance moiety_composition terminal_motifs
differential_abundance top_vs_rest motif_carriers nullsafe_full null_order_rank topk_with_ties scalar_text""".split()
FULL = os.environ.get("FULL_ORACLE") == "1"
WITH_SQL = sorted(ORACLES) if FULL else CORE
WITHOUT_SQL = sorted(set(QUERIES) - set(ORACLES)) if FULL else ["pca_scores"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = [tuple(x) for x in df.collect()]
    cur = duck.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    names = sorted(cols)
    assert sorted(df.columns) == names
    a = normal(got, [df.columns.index(c) for c in names])
    b = normal(cur.fetchall(), [cols.index(c) for c in names])
    assert a == b


def test_entry(spark):
    assert entry.entry(spark).count() >= 10


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_queries_without_sql_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0
