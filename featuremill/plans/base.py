"""Registry of queries, and the feature-by-sample view of the generated tables they share.

Stand-ins: a sample is the nation of a supplier, its condition follows the nation's region, a count
is a sum of line quantities, a feature is a part (or a symbol shared by several parts), a length is
a part size. Each Spark builder has its SQL twin next to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counts as C
from ..operators.multiple_testing import bh_adjust

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Generated table under its stated schema; no footer is read before the query runs."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def r(col: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns a negative zero into zero."""
    return F.round(col, digits) + F.lit(0.0)


def rs(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


# Samples, counts, per-million values ----------------------------------------------------------

TREATED, CONTROL = "treated", "control"


def samples(spark: SparkSession, sf: str) -> DataFrame:
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    condition = F.when(F.col("n_regionkey") < 2, CONTROL).otherwise(TREATED)
    return s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", F.col("n_name").alias("sample"), condition.alias("condition"))


def design(spark: SparkSession, sf: str) -> DataFrame:
    return samples(spark, sf).select("sample", "condition").distinct()


SAMPLES = """samples AS (SELECT s_suppkey, n_name AS sample,
  CASE WHEN n_regionkey < 2 THEN 'control' ELSE 'treated' END AS condition
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
design AS (SELECT DISTINCT sample, condition FROM samples)"""


def symbol_col() -> Column:
    return F.concat_ws(" ", "p_name", "p_brand")


def genes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), symbol_col().alias("symbol"), "p_size")


GENES = "genes AS (SELECT p_partkey AS id, p_name || ' ' || p_brand AS symbol, p_size FROM part)"


def part_counts(spark: SparkSession, sf: str) -> DataFrame:
    """(feature = part, sample, count)."""
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    return (
        li.join(samples(spark, sf), li.l_suppkey == F.col("s_suppkey"))
        .groupBy(F.col("l_partkey").alias("feature"), "sample")
        .agg(F.sum("l_quantity").alias("count"))
    )


PART_COUNTS = f"""{SAMPLES},
part_counts AS (SELECT l_partkey AS feature, sample, sum(l_quantity) AS count
  FROM lineitem JOIN samples ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


def symbol_counts(spark: SparkSession, sf: str) -> DataFrame:
    """(feature = symbol, sample, count). Rolled up from part counts, so names are joined after the sum."""
    g = genes(spark, sf).select(F.col("id").alias("feature"), "symbol")
    return part_counts(spark, sf).join(g, "feature").groupBy(F.col("symbol").alias("feature"), "sample").agg(
        F.sum("count").alias("count")
    )


COUNTS = f"""{PART_COUNTS}, {GENES},
counts AS (SELECT symbol AS feature, sample, sum(count) AS count
  FROM part_counts JOIN genes ON feature = id GROUP BY 1, 2)"""


def symbol_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return genes(spark, sf).groupBy(F.col("symbol").alias("feature")).agg((F.avg("p_size") * 100.0).alias("length"))


def symbol_tpm(spark: SparkSession, sf: str) -> DataFrame:
    """(symbol, sample, condition, count, tpm)."""
    t = C.tpm(symbol_counts(spark, sf), symbol_lengths(spark, sf))
    return t.join(design(spark, sf), "sample").withColumnRenamed("feature", "symbol")


TPM = f"""{COUNTS},
lengths AS (SELECT symbol AS feature, avg(p_size) * 100.0 AS length FROM genes GROUP BY 1),
rpk AS (SELECT feature, sample, count, count / (length / 1000.0) AS rpk FROM counts JOIN lengths USING (feature)),
tpm AS (SELECT feature AS symbol, sample, condition, count, rpk / (sum(rpk) OVER (PARTITION BY sample) / 1e6) AS tpm
  FROM rpk JOIN design USING (sample))"""


# Part-level test results ----------------------------------------------------------------------


def part_tests(spark: SparkSession, sf: str) -> DataFrame:
    """(feature, base_mean, p): mean count over samples and a p-value with ties and gaps."""
    n = design(spark, sf).agg(F.count(F.lit(1)).alias("n")).scalar()
    x = (F.col("p_retailprice") - 899.95) / 100.0
    p = F.when(F.col("p_size") < 50, x * x * x)
    totals = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("feature")).agg(F.sum("l_quantity").alias("t"))
    return (
        table(spark, sf, "part")
        .select(F.col("p_partkey").alias("feature"), p.alias("p"))
        .join(totals, "feature", "left")
        .select("feature", (F.coalesce("t", F.lit(0.0)) / n).alias("base_mean"), "p")
    )


PART_TESTS = """part_tests AS (SELECT p_partkey AS feature, coalesce(t, 0.0) / (SELECT count(*) FROM design) AS base_mean,
  CASE WHEN p_size < 50 THEN x * x * x END AS p
  FROM (SELECT *, (p_retailprice - 899.95) / 100.0 AS x FROM part)
  LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS t FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"""


def bh_sql(source: str, p: str, out: str = "padj", keys: str = "") -> str:
    """Step-up adjusted p as SQL; gives every column of ``source`` plus ``out``."""
    part = f"PARTITION BY {keys}, ({p} IS NULL)" if keys else f"PARTITION BY ({p} IS NULL)"
    return f"""SELECT * EXCLUDE (__raw), CASE WHEN {p} IS NOT NULL THEN least(1.0, min(__raw) OVER ({part} ORDER BY {p} DESC)) END AS {out}
  FROM (SELECT *, {p} * count(*) OVER ({part}) / count(*) OVER ({part} ORDER BY {p}) AS __raw FROM {source})"""


def part_results(spark: SparkSession, sf: str) -> DataFrame:
    """(feature, base_mean, p, padj, log2fc)."""
    wide = C.group_mean_wide(part_counts(spark, sf), design(spark, sf), "count", [TREATED, CONTROL])
    lfc = C.two_group_log_ratio(wide, TREATED, CONTROL).select("feature", "log2fc")
    return bh_adjust(part_tests(spark, sf), "p", "padj").join(lfc, "feature", "left")


PART_RESULTS = f"""{PART_COUNTS}, {PART_TESTS},
wide AS (SELECT feature, sum(CASE WHEN condition = 'treated' THEN count ELSE 0 END) / (SELECT count(*) FROM design WHERE condition = 'treated') AS treated,
  sum(CASE WHEN condition = 'control' THEN count ELSE 0 END) / (SELECT count(*) FROM design WHERE condition = 'control') AS control
  FROM part_counts JOIN design USING (sample) GROUP BY 1),
results AS (SELECT t.*, log2((treated + 1.0) / (control + 1.0)) AS log2fc
  FROM ({bh_sql('part_tests', 'p')}) t LEFT JOIN wide USING (feature))"""


# Tail probabilities as SQL --------------------------------------------------------------------


def normal_p_sql(z: str) -> str:
    """Two-sided normal p from the Gamma-function series of erf."""
    x = f"greatest(abs({z}) / sqrt(2.0), 1e-300)"
    return (
        f"greatest(0.0, 1.0 - list_sum(list_transform(range(0, 300), lambda n: "
        f"exp((2 * n + 1) * ln({x}) - lgamma(n + 1.5) - {x} * {x}))))"
    )


def _beta_series(a: str, b: str, x: str) -> str:
    front = f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1.0 - {x})) / {a}"
    terms = (
        f"list_sum(list_transform(range(0, 300), lambda n: exp(lgamma({a} + {b} + n) - lgamma({a} + {b})"
        f" + lgamma({a} + 1.0) - lgamma({a} + 1.0 + n) + n * ln({x}))))"
    )
    return f"({front} * {terms})"


def t_p_sql(t: str, dof: str) -> str:
    """Two-sided Student p from the power series of the incomplete beta function."""
    a, b = f"({dof} / 2.0)", "0.5"
    x, y = f"({dof} / ({dof} + {t} * {t}))", f"greatest({t} * {t} / ({dof} + {t} * {t}), 1e-300)"
    return (
        f"CASE WHEN {t} = 0 THEN 1.0 WHEN {x} < ({a} + 1.0) / ({a} + 2.5) THEN {_beta_series(a, b, x)} "
        f"ELSE 1.0 - {_beta_series(b, a, y)} END"
    )
