"""Queries on the interaction graph (parts that share an order) and on its clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.aggregate import count_rows
from ..session import cut_lineage
from .base import CONTROL, GENES, PART_RESULTS, TREATED, design, part_counts, part_results, query, r, rs, symbol_col, table
from ..operators import counts as C

STRONG = 400
PRUNE = 1e-3


def links(spark, sf):
    """All pairs of parts that share an order; the score is 20 times the smaller quantity, up to 1000."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    x, y = line.alias("x"), line.alias("y")
    both = x.join(y, (F.col("x.l_orderkey") == F.col("y.l_orderkey")) & (F.col("x.l_linenumber") < F.col("y.l_linenumber")))
    return both.select(F.col("x.l_partkey").alias("src"), F.col("y.l_partkey").alias("dst"), (F.least("x.l_quantity", "y.l_quantity") * 20.0).alias("score"))


LINKS = """links AS (SELECT x.l_partkey AS src, y.l_partkey AS dst, 20.0::DOUBLE * least(x.l_quantity, y.l_quantity) AS score
  FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber < y.l_linenumber)"""


def vertices(spark, sf):
    part = table(spark, sf, "part")
    items = part.select(symbol_col().alias("alias")).distinct()
    known = part.filter("p_size <= 43")  # the bridge knows only some parts
    return G.map_to_vertices(items, known.select(symbol_col().alias("alias"), F.col("p_partkey").alias("vertex")))


VERTICES = f"""{GENES}, vertices AS (SELECT symbol AS alias, min(id) AS vertex FROM genes WHERE p_size <= 43 GROUP BY 1)"""


@query("map_to_vertices", f"WITH {VERTICES} SELECT alias, vertex FROM vertices")
def map_to_vertices(spark, sf):
    return vertices(spark, sf)


@query("induced_edges", f"""WITH {LINKS}, {VERTICES} SELECT src, dst, score FROM links
WHERE score >= 400 AND src IN (SELECT vertex FROM vertices) AND dst IN (SELECT vertex FROM vertices)""")
def induced_edges(spark, sf):
    return G.induced_edges(links(spark, sf), vertices(spark, sf), 400).select("src", "dst", "score")


@query("simplify_graph", f"""WITH {LINKS} SELECT least(src, dst) AS a, greatest(src, dst) AS b, {rs('avg(score)', 6)} AS weight
FROM links WHERE src <> dst AND score >= 400 GROUP BY 1, 2""")
def simplify_graph(spark, sf):
    return G.simplify_graph(links(spark, sf).filter("score >= 400")).select("a", "b", r("weight").alias("weight"))


def strong_edges(spark, sf):
    return G.simplify_graph(links(spark, sf).filter(F.col("score") >= STRONG))


def _markov_sql(rounds: int) -> str:
    parts = [
        LINKS,
        f"simple AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM links WHERE src <> dst AND score >= {STRONG} GROUP BY 1, 2)",
        "arcs AS (SELECT a AS i, b AS j, 1.0::DOUBLE AS v FROM simple UNION ALL SELECT b, a, 1.0 FROM simple)",
        "cells AS (SELECT * FROM arcs UNION ALL SELECT DISTINCT j, j, 1.0 FROM arcs)",
        "m0 AS (SELECT i, j, v / sum(v) OVER (PARTITION BY j) AS v FROM cells)",
    ]
    for k in range(1, rounds + 1):
        parts.append(f"q{k} AS MATERIALIZED (SELECT x.i, y.j, power(sum(x.v * y.v), 2.5) AS v FROM m{k - 1} x JOIN m{k - 1} y ON x.j = y.i GROUP BY 1, 2)")
        parts.append(f"p{k} AS (SELECT i, j, v FROM q{k} QUALIFY v >= {PRUNE} * sum(v) OVER (PARTITION BY j) OR v >= (1 - 1e-9) * max(v) OVER (PARTITION BY j))")
        parts.append(f"m{k} AS MATERIALIZED (SELECT i, j, v / sum(v) OVER (PARTITION BY j) AS v FROM p{k})")
    return ", ".join(parts)


@query("stochastic_matrix", f"WITH {_markov_sql(0)} SELECT i, j, {rs('v', 9)} AS v FROM m0")
def stochastic_matrix(spark, sf):
    return G.stochastic_matrix(strong_edges(spark, sf)).select("i", "j", r("v", 9).alias("v"))


@query("markov_rounds", f"""WITH {_markov_sql(2)} SELECT j AS vertex, i AS cluster FROM m2
QUALIFY row_number() OVER (PARTITION BY j ORDER BY round(v, 9) DESC, i) = 1""")
def markov_rounds(spark, sf):
    matrix = cut_lineage(G.stochastic_matrix(strong_edges(spark, sf)))
    for _ in range(2):
        matrix = cut_lineage(G.markov_round(matrix, 2.5, PRUNE))
    return G.clusters_of(matrix)


#: More rounds than the clustering needs to settle; a settled matrix stays as it is.
SETTLED = 24


@query("markov_cluster", f"""WITH {_markov_sql(SETTLED)}, best AS (SELECT j AS vertex, i AS label FROM m{SETTLED}
  QUALIFY row_number() OVER (PARTITION BY j ORDER BY round(v, 9) DESC, i) = 1),
sized AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) AS cluster FROM best GROUP BY 1)
SELECT vertex, cluster FROM best JOIN sized USING (label)""")
def markov_cluster(spark, sf):
    return G.number_clusters(G.markov_cluster(strong_edges(spark, sf), 2.5, PRUNE))


# Tables around hits, sets and clusters ----------------------------------------------------------

PHRASES = ["Genes annotated with", "(mouse)"]


@query("node_annotation", """WITH m AS (SELECT DISTINCT l_partkey AS node, l_returnflag || ' ' || l_linestatus AS name FROM lineitem WHERE l_quantity >= 48)
SELECT p_partkey AS node, set_names FROM part LEFT JOIN (SELECT node, string_agg(name, ', ' ORDER BY name) AS set_names FROM m GROUP BY 1) ON node = p_partkey""")
def node_annotation(spark, sf):
    name = F.concat(F.lit("Genes annotated with  "), "l_returnflag", F.lit(" (mouse) "), "l_linestatus")
    large = table(spark, sf, "lineitem").filter("l_quantity >= 48")  # parts that never came in such a quantity have no set
    member = large.select(F.col("l_partkey").alias("node"), name.alias("name"))
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("node"))
    return G.node_annotation(nodes, member, PHRASES)


def hits(spark, sf):
    return part_results(spark, sf).filter("padj < 0.05").select(F.col("feature").alias("gene"), "log2fc", "padj")


def clusters(spark, sf):
    number = F.expr("try_cast(substring(p_brand, 7) AS bigint)")
    return table(spark, sf, "part").filter("p_size <= 35").select(F.col("p_partkey").alias("gene"), number.alias("cluster"))


def gene_sets(spark, sf):
    part = table(spark, sf, "part")
    return part.select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("term"), F.concat(F.lit("set "), F.lower("p_type")).alias("name"))


def strong_sets(spark, sf):
    """Sets with a score, the three that count as significant."""
    terms = table(spark, sf, "part").filter(F.col("p_type").isin("PROMO", "SMALL", "LARGE"))
    return terms.groupBy(F.col("p_type").alias("term")).agg((1.0 / F.count(F.lit(1))).alias("p_set"))


TABLES = f"""{PART_RESULTS}, hits AS (SELECT feature AS gene, log2fc, padj FROM results WHERE padj < 0.05),
clusters AS (SELECT p_partkey AS gene, CAST(substr(p_brand, 7) AS BIGINT) AS cluster FROM part WHERE p_size <= 35),
gene_sets AS (SELECT p_partkey AS gene, p_type AS term, 'set ' || lower(p_type) AS name FROM part),
sets AS (SELECT p_type AS term, 1.0 / count(*) AS p_set FROM part WHERE p_type IN ('PROMO', 'SMALL', 'LARGE') GROUP BY 1)"""


@query("hits_in_sets", f"""WITH {TABLES} SELECT gene, {rs('log2fc', 6)} AS log2fc, term, name, {rs('p_set', 8)} AS p_set
FROM hits LEFT JOIN gene_sets USING (gene) LEFT JOIN sets USING (term)""")
def hits_in_sets(spark, sf):
    out = G.hits_in_sets(hits(spark, sf), gene_sets(spark, sf), strong_sets(spark, sf))
    return out.select("gene", r("log2fc").alias("log2fc"), "term", "name", r("p_set", 8).alias("p_set"))


@query("cluster_annotation", f"""WITH {TABLES}, h AS (SELECT gene, log2fc, term FROM hits JOIN gene_sets USING (gene) WHERE term <> 'PROMO')
SELECT gene, cluster, {rs('log2fc', 6)} AS log2fc, term, {rs('p_set', 8)} AS p_set FROM (SELECT * FROM h FULL JOIN clusters USING (gene)) FULL JOIN sets USING (term)
WHERE log2fc IS NOT NULL OR p_set IS NOT NULL""")
def cluster_annotation(spark, sf):
    named = hits(spark, sf).join(gene_sets(spark, sf), "gene").filter("term <> 'PROMO'").select("gene", "log2fc", "term")
    out = G.cluster_annotation(strong_sets(spark, sf), named, clusters(spark, sf))
    return out.filter("log2fc IS NOT NULL OR p_set IS NOT NULL").select("gene", "cluster", r("log2fc").alias("log2fc"), "term", r("p_set", 8).alias("p_set"))


def placed(spark, sf):
    return hits(spark, sf).join(clusters(spark, sf), "gene", "left").join(gene_sets(spark, sf), "gene", "left")


@query("cluster_profile", f"""WITH {TABLES}, t AS (SELECT cluster, gene, log2fc, name FROM hits LEFT JOIN clusters USING (gene) LEFT JOIN gene_sets USING (gene))
SELECT cluster, {rs('avg(log2fc)', 6)} AS mean_log2fc, string_agg(DISTINCT name, chr(10) ORDER BY name) AS set_names FROM t GROUP BY 1""")
def cluster_profile(spark, sf):
    return G.cluster_profile(placed(spark, sf)).select("cluster", r("mean_log2fc").alias("mean_log2fc"), "set_names")


@query("cluster_counts", f"""WITH {TABLES}, t AS (SELECT CASE WHEN cluster = 1 THEN 'cluster 1' ELSE 'other' END AS side FROM hits LEFT JOIN clusters USING (gene))
SELECT side, count(*) AS n, {rs('count(*) * 100.0 / sum(count(*)) OVER ()', 6)} AS share FROM t GROUP BY 1""")
def cluster_counts(spark, sf):
    out = G.cluster_counts(hits(spark, sf).join(clusters(spark, sf), "gene", "left"))
    return out.select("side", "n", r("share").alias("share"))


@query("hits_per_cluster", f"""WITH {TABLES} SELECT cluster, count(*) AS n FROM hits LEFT JOIN clusters USING (gene) WHERE abs(log2fc) > 0.25 GROUP BY 1""")
def hits_per_cluster(spark, sf):
    return G.hits_per_cluster(hits(spark, sf).join(clusters(spark, sf), "gene", "left"), 0.25)


@query("cluster_sizes", f"WITH {TABLES} SELECT cluster, count(*) AS n FROM clusters GROUP BY 1")
def cluster_sizes(spark, sf):
    return count_rows(clusters(spark, sf), "cluster")


@query("master_table", f"""WITH {TABLES}, t AS (SELECT gene, log2fc, padj, cluster, avg(log2fc) OVER (PARTITION BY cluster) AS mc FROM hits LEFT JOIN clusters USING (gene))
SELECT cluster, {rs('mc', 6)} AS mean_cluster_log2fc, t.gene, {rs('log2fc', 6)} AS log2fc, {rs('padj', 9)} AS padj, term, name,
  {rs('control', 6)} AS control, {rs('treated', 6)} AS treated FROM t LEFT JOIN gene_sets s ON s.gene = t.gene LEFT JOIN wide ON feature = t.gene""")
def master_table(spark, sf):
    means = C.group_mean_wide(part_counts(spark, sf), design(spark, sf), "count", [CONTROL, TREATED]).withColumnRenamed("feature", "gene")
    out = G.master_table(hits(spark, sf), clusters(spark, sf), gene_sets(spark, sf), means)
    return out.select(
        "cluster", r("mean_cluster_log2fc").alias("mean_cluster_log2fc"), "gene", r("log2fc").alias("log2fc"), r("padj", 9).alias("padj"),
        "term", "name", r("control").alias("control"), r("treated").alias("treated"),
    )


@query("top_hits_with_sets", f"""WITH {TABLES}, n AS (SELECT gene, string_agg(DISTINCT name, chr(10) ORDER BY name) AS set_names FROM gene_sets GROUP BY 1)
SELECT gene, {rs('log2fc', 6)} AS log2fc, set_names, cluster FROM hits LEFT JOIN n USING (gene) LEFT JOIN clusters USING (gene) WHERE abs(log2fc) > 0.5""")
def top_hits_with_sets(spark, sf):
    out = G.top_hits_with_sets(hits(spark, sf), gene_sets(spark, sf), clusters(spark, sf), 0.5)
    return out.select("gene", r("log2fc").alias("log2fc"), "set_names", "cluster")


@query("lost_hits", f"WITH {TABLES} SELECT gene FROM hits WHERE gene NOT IN (SELECT gene FROM clusters)")
def lost_hits(spark, sf):
    """Hits that a join with the clusters would lose."""
    from ..operators.joins import keep_not_in

    return keep_not_in(hits(spark, sf).select("gene"), "gene", clusters(spark, sf), "gene")
