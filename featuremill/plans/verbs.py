"""One query per group of relational rules: null-safe keys, ordering of missing values, ties, text, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nulls as N
from ..functions import numeric as M
from ..functions import text as T
from ..operators import aggregate as A
from ..operators import joins as J
from ..operators import ordered as O
from ..operators import reshape as R
from ..operators import setops as S
from .base import query, r, rs, table

# Supplier and customer sides share a nullable key; nation 4 has another key on the right, so that either side has rows without a match.
SIDES = """l AS (SELECT c_custkey AS id, nullif(c_nationkey, 3) AS k, c_mktsegment AS seg FROM customer),
rt AS (SELECT s_suppkey AS sid, CASE WHEN s_nationkey = 4 THEN 104 ELSE nullif(s_nationkey, 3) END AS k, s_acctbal AS bal FROM supplier)"""


def _sides(spark, sf):
    left = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), N.value_to_null(F.col("c_nationkey"), 3).alias("k"), F.col("c_mktsegment").alias("seg")
    )
    right = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("sid"), F.when(F.col("s_nationkey") == 4, 104).otherwise(N.value_to_null(F.col("s_nationkey"), 3)).alias("k"), F.col("s_acctbal").alias("bal")
    )
    return left, right


@query("nullsafe_inner", f"WITH {SIDES} SELECT l.id, l.k, sid FROM l JOIN rt ON l.k IS NOT DISTINCT FROM rt.k")
def nullsafe_inner(spark, sf):
    left, right = _sides(spark, sf)
    return J.null_safe_join(left, right, ["k"], dealt=True).select("id", "k", "sid")


@query("nullsafe_full", f"WITH {SIDES} SELECT id, coalesce(l.k, rt.k) AS k, sid FROM l FULL JOIN rt ON l.k IS NOT DISTINCT FROM rt.k")
def nullsafe_full(spark, sf):
    left, right = _sides(spark, sf)
    return J.null_safe_join(left, right, ["k"], "full", dealt=True).select("id", "k", "sid")


@query("nullsafe_semi_anti", f"""WITH {SIDES} SELECT 'in' AS side, id FROM l WHERE EXISTS (SELECT 1 FROM rt WHERE rt.k IS NOT DISTINCT FROM l.k)
UNION ALL SELECT 'out', id FROM l WHERE NOT EXISTS (SELECT 1 FROM rt WHERE rt.k IS NOT DISTINCT FROM l.k)""")
def nullsafe_semi_anti(spark, sf):
    left, right = _sides(spark, sf)
    return S.stack(
        J.keep_in(left, "k", right, "k").select(F.lit("in").alias("side"), "id"),
        J.keep_not_in(left, "k", right, "k").select(F.lit("out").alias("side"), "id"),
    )


@query("left_and_renamed", f"""WITH {SIDES} SELECT o.o_orderkey, c.c_custkey AS id, c.c_mktsegment AS o_orderstatus_y, o.o_orderstatus
FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey""")
def left_and_renamed(spark, sf):
    right = table(spark, sf, "customer").filter("c_acctbal > 0").select(
        "c_custkey", F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("o_orderstatus")
    )
    out = J.join_renamed(table(spark, sf, "orders"), right, {"o_custkey": "c_custkey"}, "left")
    return out.select("o_orderkey", "id", "o_orderstatus_y", "o_orderstatus")


@query("first_match_join", """SELECT n_name, s_suppkey, s_acctbal FROM nation JOIN
(SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier) ON s_nationkey = n_nationkey AND n = 1""")
def first_match_join(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    out = J.first_match_join(nation, table(spark, sf, "supplier"), ["s_nationkey"], ["s_suppkey"])
    return out.select("n_name", "s_suppkey", "s_acctbal")


@query("multi_key_join", """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem JOIN
(SELECT l_orderkey, l_linenumber + 1 AS l_linenumber FROM lineitem) USING (l_orderkey, l_linenumber) GROUP BY 1, 2""")
def multi_key_join(spark, sf):
    li = table(spark, sf, "lineitem")
    right = li.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"))
    return A.count_rows(li.select("l_orderkey", "l_linenumber").join(right, ["l_orderkey", "l_linenumber"]), "l_orderkey", "l_linenumber")


@query("null_order_rank", """SELECT p_partkey, row_number() OVER (ORDER BY nullif(p_size, 7) NULLS LAST, p_partkey) AS up,
  row_number() OVER (ORDER BY nullif(p_size, 7) DESC NULLS LAST, p_partkey) AS down FROM part""")
def null_order_rank(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", N.value_to_null(F.col("p_size"), 7).alias("v"))
    up = O.row_rank(part, ["v", "p_partkey"], "up")
    return O.row_rank(up, ["v", "p_partkey"], "down", descending=["v"]).select("p_partkey", "up", "down")


@query("level_order", "SELECT o_orderpriority, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '4-NOT SPECIFIED' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 9 END AS ord, count(*) AS n FROM orders GROUP BY 1")
def level_order(spark, sf):
    levels = F.array(*[F.lit(v) for v in ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM")])
    place = F.array_position(levels, F.col("o_orderpriority"))
    counted = A.count_rows(table(spark, sf, "orders"), "o_orderpriority")
    return counted.select("o_orderpriority", F.when(place > 0, place).otherwise(9).cast("int").alias("ord"), "n").orderBy("ord")


@query("topk_with_ties", "SELECT p_partkey, p_size FROM part QUALIFY rank() OVER (ORDER BY p_size DESC) <= 15")
def topk_with_ties(spark, sf):
    return O.top_with_ties(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", 15)


@query("rest_after_top", "SELECT p_partkey, p_size FROM part QUALIFY rank() OVER (ORDER BY p_size) > 15")
def rest_after_top(spark, sf):
    return O.rest_after_top(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", 15, largest=False)


@query("topk_per_group", "SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) <= 3")
def topk_per_group(spark, sf):
    return O.top_per_key(table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], "p_retailprice", 3, largest=False)


@query("strict_aggregates", f"""SELECT p_brand, CASE WHEN count(v) = count(*) THEN sum(v) END AS strict_sum, sum(v) AS loose_sum,
  {rs('CASE WHEN count(v) = count(*) THEN avg(v) END', 6)} AS strict_mean, {rs('stddev_samp(v)', 6)} AS sd
  FROM (SELECT p_brand, nullif(p_size, 50)::BIGINT AS v FROM part) GROUP BY 1""")
def strict_aggregates(spark, sf):
    part = table(spark, sf, "part").select("p_brand", N.value_to_null(F.col("p_size"), 50).cast("long").alias("v"))
    v = F.col("v")
    return part.groupBy("p_brand").agg(
        N.strict(F.sum, v).alias("strict_sum"), F.sum(v).alias("loose_sum"), r(N.strict(F.avg, v)).alias("strict_mean"), r(F.stddev_samp(v)).alias("sd")
    )


@query("group_quantiles", f"""SELECT event_type, {rs('quantile_cont(value, 0.5)', 6)} AS median, {rs('quantile_cont(value, 0.9)', 6)} AS q90,
  {rs('mad(value) * 1.4826', 6)} AS mad FROM events GROUP BY 1""")
def group_quantiles(spark, sf):
    events = table(spark, sf, "events").select("event_type", "value")
    out = O.quantiles_by(events, ["event_type"], "value", {"median": 0.5, "q90": 0.9}).join(O.mad_by(events, ["event_type"], "value"), "event_type")
    return out.select("event_type", *[r(c).alias(c) for c in ("median", "q90", "mad")])


@query("count_of_counts", "SELECT n, count(*) AS keys FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def count_of_counts(spark, sf):
    return A.count_of_counts(table(spark, sf, "lineitem"), "l_orderkey")


@query("share_of_total", f"""SELECT p_type, count(*) AS n, {rs('count(*) * 100.0 / sum(count(*)) OVER ()', 6)} AS share FROM part GROUP BY 1""")
def share_of_total(spark, sf):
    return A.share_of_total(A.count_rows(table(spark, sf, "part"), "p_type"), "n").select("p_type", "n", r("share").alias("share"))


@query("group_stats_on_rows", f"""SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_suppkey) AS total,
  {rs('avg(l_extendedprice) OVER (PARTITION BY l_suppkey)', 3)} AS mean FROM lineitem""")
def group_stats_on_rows(spark, sf):
    out = A.with_group_stats(table(spark, sf, "lineitem"), ["l_suppkey"], total=F.sum("l_quantity"), mean=F.avg("l_extendedprice"))
    return out.select("l_orderkey", "l_linenumber", "total", r("mean", 3).alias("mean"))


@query("text_list", "SELECT p_brand, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS types, count(DISTINCT p_name) AS names FROM part GROUP BY 1")
def text_list(spark, sf):
    part = table(spark, sf, "part")
    names = part.groupBy("p_brand").agg(F.count_distinct("p_name").alias("names"))
    return A.text_list(part, ["p_brand"], "p_type", ", ", "types").join(names, "p_brand")


@query("row_checks", "SELECT count(*) AS rows, count(*) FILTER (WHERE p_size > 25) AS large, count(*) FILTER (WHERE p_type = 'PROMO') AS promo FROM part")
def row_checks(spark, sf):
    return A.checks(table(spark, sf, "part"), large=F.col("p_size") > 25, promo=F.col("p_type") == "PROMO")


@query("scalar_text", """SELECT p_partkey, replace(p_name, 'i', 'y') AS all_i, regexp_replace(p_name, 'l', 'L') AS first_l, replace(p_name, ' ', '') AS glued,
  'ID-' || p_name AS tagged, contains(p_name, 'ring') AS ring, substr(p_name, 1, 2) AS two, lpad(p_partkey::VARCHAR, greatest(3, length(p_partkey::VARCHAR))::INTEGER, '0') AS padded,
  CASE WHEN p_size = 9 THEN 'NA' ELSE p_size::VARCHAR END || '/' || p_type AS pasted, CASE WHEN p_brand = 'Brand#1' THEN 'first' WHEN p_brand = 'Brand#2' THEN 'second' ELSE p_brand END AS recoded,
  CASE WHEN p_type IN ('SMALL', 'ECONOMY') THEN 'low' WHEN p_type IN ('LARGE', 'PROMO') THEN 'high' ELSE p_type END AS label, upper(p_type[1]) || lower(p_type[2:]) AS titled FROM part""")
def scalar_text(spark, sf):
    name = F.col("p_name")
    part = T.recode(table(spark, sf, "part").withColumn("recoded", F.col("p_brand")), "recoded", {"Brand#1": "first", "Brand#2": "second"})
    return part.select(
        "p_partkey",
        T.replace_all(name, "i", "y").alias("all_i"),
        T.replace_first(name, "l", "L").alias("first_l"),
        T.remove_all(name, " ").alias("glued"),
        T.prefix(name, "ID-").alias("tagged"),
        T.detect(name, "ring").alias("ring"),
        T.extract(name, "^..").alias("two"),
        T.pad_left(F.col("p_partkey").cast("string"), 3).alias("padded"),
        T.paste(N.value_to_null(F.col("p_size"), 9), F.col("p_type"), sep="/").alias("pasted"),
        "recoded",
        T.canonical_label(F.col("p_type"), {"low": ["SMALL", "ECONOMY"], "high": ["LARGE", "PROMO"]}).alias("label"),
        T.title_case(F.lower("p_type")).alias("titled"),
    )


@query("scalar_numbers", f"""SELECT p_partkey, {rs('log10(p_size)', 8)} AS lg, {rs('log2(p_size)', 8)} AS l2, round_even(p_retailprice, 0) AS even,
  least(greatest(p_size - 25.0, -8.0), 8.0)::DOUBLE AS clamped, CASE WHEN p_size % 10 = 0 THEN NULL ELSE {rs('p_retailprice / (p_size % 10)', 6)} END AS ratio,
  try_cast(CASE WHEN p_size > 45 THEN 'ND' ELSE p_size::VARCHAR END AS DOUBLE) AS parsed, p_size % 10 = 0 AS zero_log FROM part""")
def scalar_numbers(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey",
        r(M.log10_inf(size.cast("double")), 8).alias("lg"),
        r(M.log2_inf(size.cast("double")), 8).alias("l2"),
        M.round_even(F.col("p_retailprice")).alias("even"),
        M.clamp(size - 25.0, -8.0, 8.0).alias("clamped"),
        r(M.ratio(F.col("p_retailprice"), size % 10)).alias("ratio"),
        M.to_double(F.when(size > 45, "ND").otherwise(size.cast("string"))).alias("parsed"),
        (M.log10_inf((size % 10).cast("double")) == M.NEG_INF).alias("zero_log"),
    )


@query("conditions", """SELECT p_partkey, CASE WHEN nullif(p_size, 5) IS NULL THEN NULL WHEN nullif(p_size, 5) > 25 THEN 'big' ELSE 'small' END AS two_way,
  CASE WHEN nullif(p_size, 5) IS NULL THEN 'unknown' WHEN nullif(p_size, 5) > 25 THEN 'big' ELSE 'small' END AS with_missing,
  CASE WHEN nullif(p_size, 5) > 40 THEN 'a' WHEN nullif(p_size, 5) > 20 THEN 'b' ELSE 'c' END AS multi,
  coalesce(nullif(p_size, 5), 0) AS filled, coalesce(nullif(p_size, 5) NOT IN (1, 2, 3), true) AS not_listed FROM part""")
def conditions(spark, sf):
    v = N.value_to_null(F.col("p_size"), 5)
    return table(spark, sf, "part").select(
        "p_partkey",
        N.ifelse(v > 25, F.lit("big"), F.lit("small")).alias("two_way"),
        N.ifelse(v > 25, F.lit("big"), F.lit("small"), F.lit("unknown")).alias("with_missing"),
        N.case_when((v > 40, F.lit("a")), (v > 20, F.lit("b")), default=F.lit("c")).alias("multi"),
        N.replace_null(v, 0).alias("filled"),
        N.not_in_constants(v, [1, 2, 3]).alias("not_listed"),
    )


@query("dates", "SELECT l_orderkey, l_linenumber, o_orderdate::DATE AS day, datediff('day', o_orderdate, l_shipdate)::INTEGER AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def dates(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    day = M.to_day(F.col("d"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", day.alias("day"), M.days_between(F.col("l_shipdate"), day).alias("days")
    )


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@query("reshape_round_trip", """SELECT p_brand AS row_key, p_type AS level, sum(p_size)::BIGINT AS total FROM part GROUP BY 1, 2""")
def reshape_round_trip(spark, sf):
    sums = table(spark, sf, "part").groupBy(F.col("p_brand").alias("row_key"), "p_type").agg(F.sum("p_size").alias("v"))
    wide = R.to_wide(sums, ["row_key"], "p_type", "v", TYPES)
    return R.to_long(wide, ["row_key"], TYPES, "level", "total").filter("total IS NOT NULL")


@query("transpose", "SELECT p_type AS \"column\", " + ", ".join(f"count(*) FILTER (WHERE p_brand = '{b}') AS b{i}" for i, b in enumerate(BRANDS, 1)) + " FROM part GROUP BY 1")
def transpose(spark, sf):
    wide = table(spark, sf, "part").groupBy("p_brand").agg(*[F.count_if(F.col("p_type") == t).alias(t) for t in TYPES])
    out = R.transpose(wide, "p_brand", TYPES, BRANDS)
    return out.select("column", *[F.coalesce(F.col(f"`{b}`"), F.lit(0)).alias(f"b{i}") for i, b in enumerate(BRANDS, 1)])


@query("split_and_unite", """SELECT p_partkey, split_part(p_name, ' ', 1) AS adjective, split_part(p_name, ' ', 2) AS noun,
  coalesce(nullif(p_size, 4)::VARCHAR, 'NA') || '_' || p_type AS united FROM part""")
def split_and_unite(spark, sf):
    part = table(spark, sf, "part").withColumn("v", N.value_to_null(F.col("p_size"), 4))
    out = R.split_column(R.unite(part, "united", ["v", "p_type"]), "p_name", " ", ["adjective", "noun"])
    return out.select("p_partkey", "adjective", "noun", "united")


@query("column_verbs", """SELECT p_type, p_size AS P_SIZE, upper(p_name) AS P_NAME, 'part' AS origin, p_partkey AS P_PARTKEY FROM part""")
def column_verbs(spark, sf):
    part = R.relocate(table(spark, sf, "part"), "p_type").drop("p_brand", "p_retailprice")
    part = R.across(part, F.upper, ["p_name"]).withColumn("origin", F.lit("part"))
    return R.rename_all(part, lambda c: c.upper() if c in ("p_size", "p_name", "p_partkey") else c)


@query("ordered_intersect", """SELECT p_name, min(p_partkey) AS rank FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size = 50) GROUP BY 1""")
def ordered_intersect(spark, sf):
    part = table(spark, sf, "part")
    ranked = part.select("p_name", F.col("p_partkey").alias("rank"))
    return S.ordered_intersect(ranked, "p_name", "rank", part.filter("p_size = 50"), "p_name")


@query("set_equality", """SELECT 'same' AS pair, NOT EXISTS (SELECT p_brand FROM part EXCEPT SELECT p_brand FROM part WHERE p_brand IS NOT NULL) AS equal
UNION ALL SELECT 'other', NOT EXISTS (SELECT p_brand FROM part EXCEPT SELECT p_brand FROM part WHERE p_brand <> 'Brand#1')""")
def set_equality(spark, sf):
    part = table(spark, sf, "part").select("p_brand")
    same = S.set_equal(part, part.filter("p_brand IS NOT NULL"), ["p_brand"]).select(F.lit("same").alias("pair"), "equal")
    other = S.set_equal(part, part.filter("p_brand <> 'Brand#1'"), ["p_brand"]).select(F.lit("other").alias("pair"), "equal")
    return S.stack(same, other)


@query("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf):
    return S.stack_distinct(
        table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    )


@query("drop_incomplete", "SELECT p_partkey, p_size FROM part WHERE p_size <> 6 AND p_size % 9 <> 0")
def drop_incomplete(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", N.value_to_null(F.col("p_size"), 6).alias("p_size"))
    return part.withColumn("p_size", F.when(F.col("p_size") % 9 != 0, F.col("p_size"))).na.drop("any")
