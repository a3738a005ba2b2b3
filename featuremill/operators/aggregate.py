"""Aggregation verbs. Group totals are attached by aggregate-and-join, not by a window:

the aggregate combines on the map side, so a group with a third of all rows costs one row per task,
and the join back is a broadcast when the totals are small or a skew-split merge join when not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import strict
from .joins import null_safe_join


def with_group_stats(df: DataFrame, keys: list[str], **stats: Column) -> DataFrame:
    """Add per-group aggregates to every row. Missing keys form a group of their own."""
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return null_safe_join(df, totals, keys)


def with_table_stats(df: DataFrame, **stats: Column) -> DataFrame:
    """Add whole-table aggregates as scalar subqueries; each is computed once."""
    return df.withColumns({n: df.groupBy().agg(c.alias(n)).scalar() for n, c in stats.items()})


def count_rows(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def count_of_counts(df: DataFrame, *keys: str) -> DataFrame:
    """How many keys occur once, twice, and so on."""
    return count_rows(count_rows(df, *keys), "n", name="keys")


def repeated_keys(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Keys that occur more than once."""
    return count_rows(df, *keys, name=name).filter(F.col(name) > 1)


def describe(df: DataFrame, cols: list[str], na_rm: bool = False) -> DataFrame:
    """One row per column with mean, median, min and max. A missing value makes them missing, unless ``na_rm`` skips it."""
    from .ordered import median_by

    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in cols])
    long = df.select(F.inline(pairs))
    v = F.col("value")
    whole = F.lit(True) if na_rm else F.count(F.lit(1)) == F.count(v)
    basic = long.groupBy("variable").agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), whole.alias("__whole"))
    both = basic.join(median_by(long, ["variable"], "value"), "variable", "left")
    return both.select("variable", *[F.when(F.col("__whole"), F.col(c)).alias(c) for c in ("mean", "median", "min", "max")])


def mean_and_sd(df: DataFrame, col: str, na_rm: bool = False) -> DataFrame:
    """Mean and standard deviation; a missing value makes them missing, unless ``na_rm`` skips it."""
    take = (lambda f: f(F.col(col))) if na_rm else (lambda f: strict(f, F.col(col)))
    return df.agg(take(F.avg).alias("mean"), take(F.stddev_samp).alias("sd"))


def share_of_total(df: DataFrame, value: str, out: str = "share") -> DataFrame:
    """Percent of the whole-table total."""
    total = df.groupBy().agg(F.sum(value).alias("t")).scalar()
    return df.withColumn(out, F.try_divide(F.col(value) * 100.0, total))


def text_list(df: DataFrame, keys: list[str], col: str, sep: str, out: str) -> DataFrame:
    """Distinct values per key joined in sorted order.

    Values are de-duplicated before they are gathered, so a key gathers its distinct labels only.
    """
    return (
        df.select(*keys, col)
        .distinct()
        .groupBy(*keys)
        .agg(F.array_join(F.sort_array(F.collect_list(col)), sep).alias(out))
    )


def checks(df: DataFrame, **tests: Column) -> DataFrame:
    """Row counts under several conditions in one pass."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in tests.items()])
