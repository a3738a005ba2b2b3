"""Queries that reconcile identifiers and combine annotation sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotate as A
from ..operators.multiple_testing import bh_adjust
from ..operators.setops import stack
from .base import PART_TESTS, SAMPLES, bh_sql, part_tests, query, r, rs, table


def _items(spark, sf):
    symbol = F.concat(F.lit("N"), "c_nationkey", F.lit("-"), F.floor(F.col("c_custkey") / 7))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), symbol.alias("symbol"))


def _legend(spark, sf):
    key = F.col("s_suppkey") * 3
    symbol = F.concat(F.lit("N"), "s_nationkey", F.lit("-"), F.floor(key / 7))
    return table(spark, sf, "supplier").select(key.alias("ext_id"), symbol.alias("ext_symbol"))


_CASCADE = """items AS (SELECT c_custkey AS id, 'N' || c_nationkey || '-' || (c_custkey // 7) AS symbol FROM customer),
legend AS (SELECT DISTINCT s_suppkey * 3 AS ext_id, 'N' || s_nationkey || '-' || ((s_suppkey * 3) // 7) AS ext_symbol FROM supplier),
t1 AS (SELECT id, symbol, ext_id, ext_symbol, 'id_and_symbol' AS tier FROM items JOIN legend ON id = ext_id AND symbol = ext_symbol),
t2 AS (SELECT id, symbol, ext_id, ext_symbol, 'id_only' AS tier FROM items JOIN legend ON id = ext_id WHERE id NOT IN (SELECT id FROM t1)),
rest AS (SELECT * FROM items WHERE id NOT IN (SELECT id FROM t1) AND id NOT IN (SELECT id FROM t2)),
t3 AS (SELECT id, symbol, ext_id, ext_symbol, 'symbol_only' AS tier FROM rest JOIN {by_symbol} ON symbol = ext_symbol),
t4 AS (SELECT id, symbol, id AS ext_id, symbol AS ext_symbol, 'none' AS tier FROM rest WHERE id NOT IN (SELECT id FROM t3))
SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3 UNION ALL SELECT * FROM t4"""


@query("reconcile_ids_first", "WITH " + _CASCADE.format(by_symbol="(SELECT min(ext_id) AS ext_id, ext_symbol FROM legend GROUP BY 2)"))
def reconcile_ids_first(spark, sf):
    return A.reconcile_ids(_items(spark, sf), _legend(spark, sf), first_symbol_match=True)


@query("reconcile_ids_all", "WITH " + _CASCADE.format(by_symbol="legend"))
def reconcile_ids_all(spark, sf):
    return A.reconcile_ids(_items(spark, sf), _legend(spark, sf), first_symbol_match=False)


@query("match_counts", "SELECT tier, count(*) AS n FROM (WITH " + _CASCADE.format(by_symbol="(SELECT min(ext_id) AS ext_id, ext_symbol FROM legend GROUP BY 2)") + ") GROUP BY 1")
def match_counts(spark, sf):
    return A.match_counts(_items(spark, sf), _legend(spark, sf))


@query("annotate_many", """WITH b1 AS (SELECT p_partkey AS id, nullif(CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END, '') AS ext FROM part),
b2 AS (SELECT DISTINCT p_name AS ext, p_type AS term FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')),
b3 AS (SELECT DISTINCT p_type AS term, 'term ' || lower(p_type) AS term_name FROM part WHERE p_type <> 'PROMO')
SELECT id, ext, term, term_name FROM b1 LEFT JOIN b2 USING (ext) LEFT JOIN b3 USING (term)""")
def annotate_many(spark, sf):
    part = table(spark, sf, "part")
    items = part.select(F.col("p_partkey").alias("id"))
    b1 = part.select(F.col("p_partkey").alias("key"), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_name")).alias("ext"))
    b2 = part.filter(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3")).select(F.col("p_name").alias("key"), F.col("p_type").alias("term"))
    b3 = part.filter("p_type <> 'PROMO'").select(F.col("p_type").alias("key"), F.concat(F.lit("term "), F.lower("p_type")).alias("term_name"))
    out = A.annotate_many(items, (b1, "key", "id"), (b2, "key", "ext"), (b3, "key", "term"))
    return out.select("id", F.nullif("ext", F.lit("")).alias("ext"), "term", "term_name")


def _source(spark, sf, low, high, tag):
    part = table(spark, sf, "part").filter(F.col("p_size").between(low, high))
    return part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("term"), F.lower("p_type").alias("name"), F.lit(tag).alias("source"))


def _source_sql(low, high, tag):
    return f"SELECT p_partkey AS id, p_type AS term, lower(p_type) AS name, '{tag}' AS source FROM part WHERE p_size BETWEEN {low} AND {high}"


@query("merge_sources", f"""WITH a AS ({_source_sql(1, 30, 'BP')}), b AS ({_source_sql(20, 45, 'BP')}), c AS (SELECT * FROM a UNION SELECT * FROM b)
SELECT p_partkey AS id, term, name, source FROM part LEFT JOIN c ON id = p_partkey""")
def merge_sources(spark, sf):
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    a, b = _source(spark, sf, 1, 30, "BP"), _source(spark, sf, 20, 45, "biological_process")
    return A.merge_sources(items, a, b, {"biological_process": "BP"})


@query("coverage", f"""WITH {SAMPLES}, {PART_TESTS}, hits AS (SELECT feature FROM ({bh_sql('part_tests', 'p')}) WHERE padj < 0.05)
SELECT count(*) AS items, count(*) FILTER (WHERE p_size > 40) AS unannotated,
  count(*) FILTER (WHERE p_size > 40 AND p_partkey IN (SELECT feature FROM hits)) AS unannotated_hits FROM part""")
def coverage(spark, sf):
    part = table(spark, sf, "part").withColumnRenamed("p_partkey", "id")
    hits = bh_adjust(part_tests(spark, sf)).filter("padj < 0.05").withColumnRenamed("feature", "id")
    return A.coverage(part, part.filter("p_size <= 40"), hits)


@query("source_diff", f"""WITH a AS ({_source_sql(1, 30, 'x')}), b AS ({_source_sql(20, 45, 'x')})
SELECT id, term, 'a' AS side FROM (SELECT id, term FROM a EXCEPT SELECT id, term FROM b)
UNION ALL SELECT id, term, 'b' FROM (SELECT id, term FROM b EXCEPT SELECT id, term FROM a)""")
def source_diff(spark, sf):
    return A.source_diff(_source(spark, sf, 1, 30, "x"), _source(spark, sf, 20, 45, "x"))


_TERM = "p_name || ' ' || p_brand || ' ' || p_type"
_PARENT = "CASE WHEN p_size > 30 THEN p_name || ' ' || p_brand ELSE " + _TERM + " END"


@query("term_diff", f"""WITH a AS (SELECT {_TERM} AS term FROM part), b AS (SELECT {_PARENT} AS term FROM part)
SELECT term, 'a' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) WHERE term IS NOT NULL
UNION ALL SELECT term, 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) WHERE term IS NOT NULL""")
def term_diff(spark, sf):
    """Both sources annotate every part; the second knows large parts by the parent term alone."""
    part = table(spark, sf, "part")
    parent = F.concat("p_name", F.lit(" "), "p_brand")
    term = F.concat(parent, F.lit(" "), "p_type")
    a, b = part.select(term.alias("term")), part.select(F.when(F.col("p_size") > 30, parent).otherwise(term).alias("term"))
    return A.term_diff(a, b)


def annotation_table(spark, sf):
    part = table(spark, sf, "part")
    return A.build_annotation_table(
        (part.select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("term"), F.lower("p_type").alias("name")), "types"),
        (part.select(F.col("p_partkey").alias("gene"), F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_name")).alias("term"), F.col("p_name").alias("name")), "names"),
        (A.clean_prefix(part.select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("term"), F.col("p_brand").alias("name")), "term", "Brand#"), "brands"),
    )


ANNOTATION = """annotation AS (SELECT p_partkey::VARCHAR AS gene, p_type AS term, lower(p_type) AS name, 'types' AS db FROM part
UNION SELECT p_partkey::VARCHAR, p_name, p_name, 'names' FROM part WHERE p_size % 7 <> 0
UNION SELECT p_partkey::VARCHAR, replace(p_brand, 'Brand#', ''), p_brand, 'brands' FROM part)"""


@query("build_annotation_table", f"WITH {ANNOTATION} SELECT * FROM annotation")
def build_annotation_table(spark, sf):
    return annotation_table(spark, sf)


def gene_tests(spark, sf):
    """Adjusted tests of the parts, keyed by text as the annotation table is."""
    return bh_adjust(part_tests(spark, sf)).select(F.col("feature").cast("string").alias("gene"), "p", "padj")


@query("reference_and_rank", f"""WITH {SAMPLES}, {PART_TESTS}, tests AS ({bh_sql('part_tests', 'p')}),
ref AS (SELECT DISTINCT p_partkey::VARCHAR AS gene FROM part WHERE p_size % 7 <> 0 AND p_partkey IN (SELECT l_partkey FROM lineitem))
SELECT feature::VARCHAR AS gene, row_number() OVER (ORDER BY padj NULLS LAST, feature::VARCHAR) AS rank FROM tests WHERE feature::VARCHAR IN (SELECT gene FROM ref)""")
def reference_and_rank(spark, sf):
    detected = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("gene"))
    named = annotation_table(spark, sf).filter("db = 'names'")
    return A.ranked_list(gene_tests(spark, sf), A.reference_set(detected, named))


@query("unannotated_union", """SELECT 'large' AS kind, p_partkey AS id FROM part WHERE p_size > 45 UNION ALL
SELECT 'unsold in bulk', p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48)""")
def unannotated_union(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_size")
    sold = table(spark, sf, "lineitem").filter("l_quantity >= 48").select(F.col("l_partkey").alias("id"))
    large = A.unannotated(part, part.filter("p_size <= 45")).select(F.lit("large").alias("kind"), "id")
    unsold = A.unannotated(part, sold).select(F.lit("unsold in bulk").alias("kind"), "id")
    return stack(large, unsold)
