"""Queries that describe, fit and test."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inference as I
from ..operators import ordination as O
from ..operators.aggregate import describe, mean_and_sd
from ..session import cut_lineage
from .base import COUNTS, design, normal_p_sql, query, r, rs, symbol_counts, table
from .counts import norm

DESCRIBED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe_long", "\nUNION ALL ".join(
    f"SELECT '{c}' AS variable, {rs(f'avg({c})', 4)} AS mean, {rs(f'median({c})', 4)} AS median, min({c}) AS min, max({c}) AS max FROM lineitem"
    for c in DESCRIBED))
def describe_long(spark, sf):
    out = describe(table(spark, sf, "lineitem"), DESCRIBED)
    return out.select("variable", r("mean", 4).alias("mean"), r("median", 4).alias("median"), "min", "max")


@query("global_mean_sd", f"SELECT {rs('avg(o_totalprice)', 3)} AS mean, {rs('stddev_samp(o_totalprice)', 3)} AS sd FROM orders")
def global_mean_sd(spark, sf):
    return mean_and_sd(table(spark, sf, "orders"), "o_totalprice").select(r("mean", 3).alias("mean"), r("sd", 3).alias("sd"))


@query("linear_fit", f"""SELECT l_returnflag, {rs('regr_slope(l_extendedprice, l_quantity)', 4)} AS slope,
  {rs('regr_intercept(l_extendedprice, l_quantity)', 3)} AS intercept, {rs('regr_r2(l_extendedprice, l_quantity)', 8)} AS r2,
  regr_count(l_extendedprice, l_quantity)::BIGINT AS n FROM lineitem GROUP BY 1""")
def linear_fit(spark, sf):
    out = I.linear_fit(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return out.select("l_returnflag", r("slope", 4).alias("slope"), r("intercept", 3).alias("intercept"), r("r2", 8).alias("r2"), "n")


@query("fitted_line", f"""SELECT o_orderkey, {rs("(SELECT regr_intercept(o_totalprice, datediff('day', DATE '1995-01-01', o_orderdate)) FROM orders) + "
  "(SELECT regr_slope(o_totalprice, datediff('day', DATE '1995-01-01', o_orderdate)) FROM orders) * datediff('day', DATE '1995-01-01', o_orderdate)", 3)} AS fitted FROM orders""")
def fitted_line(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).alias("days")
    )
    return I.fitted_line(o, "o_totalprice", "days").select("o_orderkey", r("fitted", 3).alias("fitted"))


RANK_SUM = """counted AS (SELECT user_id, value, count(*) FILTER (WHERE event_type = 'click') AS a, count(*) AS t
  FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2),
ranked AS (SELECT *, sum(t) OVER (PARTITION BY user_id ORDER BY value) - (t - 1) / 2.0 AS mid FROM counted),
sums AS (SELECT user_id, sum(a)::DOUBLE AS n1, sum(t - a)::DOUBLE AS n2, sum(a * mid)::DOUBLE AS rs, sum(t ** 3 - t)::DOUBLE AS ties FROM ranked GROUP BY 1),
u AS (SELECT *, rs - n1 * (n1 + 1) / 2 AS u FROM sums),
z AS (SELECT *, (u - n1 * n2 / 2 - sign(u - n1 * n2 / 2) * 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u)"""


@query("rank_sum", f"""WITH {RANK_SUM} SELECT user_id, n1::BIGINT AS n1, n2::BIGINT AS n2, {rs('u', 1)} AS u, {rs('z', 6)} AS z, {rs(normal_p_sql('z'), 7)} AS p FROM z""")
def rank_sum(spark, sf):
    out = I.rank_sum_test(table(spark, sf, "events"), ["user_id"], "value", "event_type", "click", "view")
    return out.select("user_id", "n1", "n2", r("u", 1).alias("u"), r("z").alias("z"), r("p", 7).alias("p"))


@query("overlap_counts", "SELECT p_brand, p_size, p_type, count(*) AS n FROM part GROUP BY 1, 2, 3")
def overlap_counts(spark, sf):
    return I.overlap_counts(table(spark, sf, "part"), "p_brand", "p_size", "p_type")


# Samples in feature space ---------------------------------------------------------------------


def _logged(spark, sf):
    return symbol_counts(spark, sf).withColumn("x", F.log2(F.col("count") + 1.0))


@query("pca_scores")
def pca_scores(spark, sf):
    logged = norm(spark, sf).withColumn("x", F.log2(F.col("norm") + 1.0))
    return O.pca_samples(logged, design(spark, sf), "x", k=5)


@query("explained_variance")
def explained_variance(spark, sf):
    return O.explained_variance(O.pca_samples(_logged(spark, sf), design(spark, sf), "x", k=5, scale=True))


@query("pca_embeddings")
def pca_embeddings(spark, sf):
    return O.pca_points(table(spark, sf, "embeddings"), "vec_id", "embedding", k=5)


DISTANCES = f"""{COUNTS},
cells AS (SELECT d.sample, f.feature, coalesce(log2(count + 1.0), 0.0) AS x FROM design d CROSS JOIN (SELECT DISTINCT feature FROM counts) f
  LEFT JOIN counts c ON c.sample = d.sample AND c.feature = f.feature),
dist AS (SELECT l.sample AS a, r.sample AS b, sqrt(sum((l.x - r.x) ** 2)) AS distance FROM cells l JOIN cells r ON l.feature = r.feature AND l.sample < r.sample GROUP BY 1, 2)"""


@query("pairwise_distance", f"WITH {DISTANCES} SELECT a, b, {rs('distance', 6)} AS distance FROM dist")
def pairwise_distance(spark, sf):
    return O.pairwise_distance(_logged(spark, sf), design(spark, sf), "x").select("a", "b", r("distance").alias("distance"))


@query("knn_graph", f"""WITH {DISTANCES}, both_ways AS (SELECT a, b, distance FROM dist UNION ALL SELECT b, a, distance FROM dist)
SELECT a AS sample, b AS neighbour, {rs('distance', 6)} AS distance, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS nth FROM both_ways
QUALIFY nth <= 8""")
def knn_graph(spark, sf):
    out = O.knn_graph(O.pairwise_distance(_logged(spark, sf), design(spark, sf), "x"), 8)
    return out.select("sample", "neighbour", r("distance").alias("distance"), F.col("nth").cast("long").alias("nth"))


@query("knn_points", f"""WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT x.id, y.id AS neighbour, list_distance(x.v, y.v) AS distance FROM p x JOIN p y ON x.id <> y.id)
SELECT id, neighbour, {rs('distance', 6)} AS distance, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS nth FROM d QUALIFY nth <= 8""")
def knn_points(spark, sf):
    """Neighbours of many points by their whole vectors."""
    points = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return O.nearest(points, 8).select("id", "neighbour", r("distance").alias("distance"), F.col("nth").cast("long").alias("nth"))


@query("knn_scores")
def knn_scores(spark, sf):
    """Neighbours of many points on their first five components."""
    scores = O.pca_points(table(spark, sf, "embeddings"), "vec_id", "embedding", k=5)
    return O.nearest(cut_lineage(scores.select(F.col("vec_id").alias("id"), F.col("scores").alias("v"))), 8)


@query("knn_components")
def knn_components(spark, sf):
    return O.knn_on_components(_logged(spark, sf), design(spark, sf), "x", 8, 5)
