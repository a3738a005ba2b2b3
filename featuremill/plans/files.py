"""Round trips through files: a given table is written to a new shared folder in a format and read back by the reader for it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import pad_single_digit
from ..operators.joins import bind_columns
from ..operators.ordered import first_rows, unequal_positions
from ..operators.reshape import by_position
from ..session import stage_folder
from ..sources import readers as R
from ..sources import writers as W
from .base import SCHEMAS, query, table


def folder(spark) -> str:
    return f"{stage_folder(spark)}/files-{uuid.uuid4().hex}"


PART = "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part"


@query("tsv_round_trip", PART)
def tsv_round_trip(spark, sf):
    path = folder(spark)
    W.write_tsv(table(spark, sf, "part"), path)
    return R.read_tsv(spark, path, SCHEMAS["part"], check_header=True)


@query("csv_round_trip", PART)
def csv_round_trip(spark, sf):
    path = folder(spark)
    W.write_csv(table(spark, sf, "part"), path)
    return R.read_tsv(spark, path, SCHEMAS["part"], sep=",")


@query("headerless_round_trip", "SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def headerless_round_trip(spark, sf):
    path = folder(spark)
    W.write_tsv(table(spark, sf, "customer"), path, header=False)
    return R.read_tsv_headerless(spark, path, "id bigint, name string, nation int, balance double, segment string")


@query("compressed_round_trip", "SELECT l_orderkey AS \"order\", l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem")
def compressed_round_trip(spark, sf):
    """Gzip text whose first column name starts with #, renamed after reading."""
    path = folder(spark)
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("#order"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    W.write_tsv(li, path, compression="gzip")
    out = R.read_tsv(spark, path, "`#order` bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double")
    return out.withColumnRenamed("#order", "order")


@query("edge_list_round_trip", "SELECT l_partkey AS src, l_suppkey AS dst, l_quantity * 20 AS score FROM lineitem")
def edge_list_round_trip(spark, sf):
    path = folder(spark)
    edges = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), (F.col("l_quantity") * 20).alias("score"))
    W.write_tsv(edges, path, sep=" ")
    return R.read_space_delimited(spark, path, "src bigint, dst bigint, score double")


@query("sample_files", "SELECT event_type AS sample, event_id, user_id, value FROM events")
def sample_files(spark, sf):
    """A folder per sample, written in one job and read in one scan."""
    path = folder(spark)
    W.write_sample_files(table(spark, sf, "events").select("event_type", "event_id", "user_id", "value"), path, "event_type")
    return R.read_sample_files(spark, f"{path}/*", "event_id bigint, user_id bigint, value double", R.FOLDER_TAG)


@query("multi_header", "SELECT s_suppkey AS key_id, s_acctbal AS money_balance, s_name AS text_name FROM supplier")
def multi_header(spark, sf):
    """Two header lines in each file; a column's name is made of both."""
    path = folder(spark)
    body = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", "s_name")
    W.write_multi_header(body, path, [["key", "money", "text"], ["id", "balance", "name"]])
    return R.read_multi_header(spark, path, 2, "_".join, {"key_id": "bigint", "money_balance": "double"})


@query("typed_table", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def typed_table(spark, sf):
    path = folder(spark)
    W.write_table(table(spark, sf, "orders"), path)
    return R.read_table(spark, path)


@query("bridge_extract", "SELECT DISTINCT p_name, p_brand FROM part")
def bridge_extract(spark, sf):
    path = folder(spark)
    W.write_table(table(spark, sf, "part"), path)
    return R.read_bridge(spark, path, "p_name", "p_brand")


@query("blank_rows", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def blank_rows(spark, sf):
    """Rows without any value, as spreadsheets leave them at the end, are rejected."""
    path = folder(spark)
    nation = table(spark, sf, "nation")
    W.write_tsv(nation.unionByName(nation.select(*[F.lit(None).cast(t).alias(c) for c, t in nation.dtypes])), path)
    return R.read_tsv(spark, path, SCHEMAS["nation"])


@query("bad_cells", """SELECT 'o_orderkey' AS "column", 0 AS bad UNION ALL SELECT 'o_totalprice', count(*) FILTER (WHERE o_orderstatus = 'F') FROM orders""")
def bad_cells(spark, sf):
    path = folder(spark)
    price = F.when(F.col("o_orderstatus") == "F", "n/a").otherwise(F.col("o_totalprice").cast("string"))
    W.write_tsv(table(spark, sf, "orders").select("o_orderkey", price.alias("o_totalprice")), path)
    schema = table(spark, sf, "orders").select("o_orderkey", "o_totalprice").schema
    return R.bad_cells(spark, path, schema)


@query("reused_table", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def reused_table(spark, sf):
    """Built once, then read; the second call would fail if it built again."""
    path = folder(spark)
    W.reuse_or_build(lambda: table(spark, sf, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")), spark, path)
    return W.reuse_or_build(None, spark, path)


@query("columns_by_position", "SELECT p_name, p_brand, p_type FROM part")
def columns_by_position(spark, sf):
    part = table(spark, sf, "part")
    return part.select(*by_position(part, 2, 4))


@query("bound_columns", "SELECT s_nationkey AS k, count(*) AS suppliers, customers FROM supplier JOIN (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) ON c_nationkey = s_nationkey GROUP BY 1, customers")
def bound_columns(spark, sf):
    left = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    right = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    return bind_columns(left, right, ["k"])


@query("padded_digits", "SELECT p_partkey, 'PC' || lpad((p_size % 20)::VARCHAR, 2, '0') AS name FROM part")
def padded_digits(spark, sf):
    return table(spark, sf, "part").select("p_partkey", pad_single_digit(F.concat(F.lit("PC"), (F.col("p_size") % 20).cast("string"))).alias("name"))


@query("list_as_table", "SELECT l.rank, value, count(o_orderkey) AS n FROM (VALUES ('5-LOW', 1), ('1-URGENT', 2), ('none', 3)) l(value, rank) LEFT JOIN orders ON o_orderpriority = value GROUP BY 1, 2")
def list_as_table(spark, sf):
    """A list as a table that keeps its order, counted against a column."""
    names = R.literal_list(spark, ["5-LOW", "1-URGENT", "none"])
    counted = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return names.join(counted, "value", "left").select("rank", "value", F.coalesce("n", F.lit(0)).alias("n"))


@query("first_rows", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 12")
def first_rows_query(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return first_rows(li, ["l_extendedprice", "l_orderkey", "l_linenumber"], 12)


@query("unequal_positions", """WITH a AS (SELECT row_number() OVER (ORDER BY p_partkey) AS rank, p_brand AS "left" FROM part),
b AS (SELECT row_number() OVER (ORDER BY p_size, p_partkey) AS rank, p_brand AS "right" FROM part WHERE p_size > 5)
SELECT rank, "left", "right" FROM a FULL JOIN b USING (rank) WHERE "left" IS DISTINCT FROM "right" """)
def unequal(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_brand")
    return unequal_positions(part, part.filter("p_size > 5"), "p_brand", ["p_partkey"], ["p_size", "p_partkey"])
