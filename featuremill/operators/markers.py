"""Marker lists against per-million values: specificity, category expression, abundance cutoffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import log2_inf, log10_inf
from ..functions.nulls import not_in_constants
from .aggregate import count_rows
from .joins import full_join, keep_in, keep_not_in, null_safe_join
from .ordered import top_with_ties

_PAIR = ["symbol", "category", "organ"]


def ambiguous_markers(database: DataFrame, curated: DataFrame, categories: list[str], exempt: list[str]) -> DataFrame:
    """Symbols that mark other than exactly one row among the wanted categories of both sources."""
    both = full_join(database, curated, _PAIR)
    return (
        count_rows(both.filter(not_in_constants(F.col("symbol"), exempt) & F.col("category").isin(categories)), "symbol")
        .filter(F.col("n") != 1)
        .select("symbol")
    )


def specific_markers(
    database: DataFrame,
    curated: DataFrame,
    categories: list[str],
    species: list[str],
    exempt: list[str],
    drop_pairs: list[tuple[str, str]],
) -> DataFrame:
    """Canonical, species-matching, specific markers of one category, joined with the curated list."""
    kept = database.filter(
        (F.col("canonical") == 1) & ~(F.col("specificity") > 0) & F.col("species").isin(species)
    )
    merged = full_join(kept, curated, _PAIR)
    for symbol, category in drop_pairs:
        merged = merged.filter(~F.coalesce((F.col("symbol") == symbol) & (F.col("category") == category), F.lit(False)))
    merged = merged.filter(F.col("category").isin(categories))
    return keep_not_in(merged, "symbol", ambiguous_markers(database, curated, categories, exempt), "symbol")


def category_expression(markers: DataFrame, values: DataFrame, samples: DataFrame) -> DataFrame:
    """Markers with their per-million values, logs, and the mean per category.

    The mean runs over every marker of the category and every sample; an absent cell, which has no row, is a zero in it.
    """
    n = samples.select("sample").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    joined = markers.select("category", "symbol").join(values.select("symbol", "sample", "condition", "tpm"), "symbol").distinct()
    logged = joined.withColumns({"tpm_log10": log10_inf(F.col("tpm")), "tpm_log2": log2_inf(F.col("tpm"))})
    means = joined.groupBy("category", "symbol").agg(F.sum("tpm").alias("t")).groupBy("category").agg((F.sum("t") / (F.count(F.lit(1)) * n)).alias("mean_category_tpm"))
    return null_safe_join(logged, means, ["category"])


def markers_per_category(markers: DataFrame) -> DataFrame:
    return count_rows(markers.select("category", "symbol").distinct(), "category")


def markers_in_hits(markers: DataFrame, hits: DataFrame) -> DataFrame:
    """Per category with at least one marker among the hits: markers in hits and markers in all."""
    pairs = markers.select("category", "symbol").distinct()
    found = keep_in(pairs, "symbol", hits, "symbol")
    return count_rows(found, "category", name="hits").join(markers_per_category(pairs).withColumnRenamed("n", "markers"), "category")


def anchor_minimum(values: DataFrame, anchor, samples: DataFrame) -> Column:
    """Smallest value of one anchor symbol over all samples, as a scalar subquery; zero when a sample lacks it."""
    n = samples.select("sample").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    whole = F.count_distinct("sample") == n
    return values.filter(F.col("symbol") == anchor).agg(F.when(whole, F.min("tpm")).otherwise(0.0).alias("m")).scalar()


def complete_symbol(values: DataFrame, samples: DataFrame) -> Column:
    """The smallest symbol that every sample has, as a scalar subquery: a usable anchor."""
    n = samples.select("sample").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return values.groupBy("symbol").agg(F.count_distinct("sample").alias("n")).filter(F.col("n") == n).agg(F.min("symbol").alias("m")).scalar()


def group_means(values: DataFrame, condition: str, samples: DataFrame | None = None) -> DataFrame:
    """(symbol, mean_tpm, mean_log10, max_tpm) over the samples of one condition.

    The samples are those of ``samples`` (sample, condition), or else those that occur. An absent cell is a zero: it enters the mean, and makes the mean of logs minus infinity.
    """
    group = values.filter(F.col("condition") == condition)
    design = values if samples is None else samples
    n = design.filter(F.col("condition") == condition).select("sample").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    logs = F.when(F.count(F.lit(1)) < n, F.lit(float("-inf"))).otherwise(F.sum(log10_inf(F.col("tpm"))) / n)
    return group.groupBy("symbol").agg(
        (F.sum("tpm") / n).alias("mean_tpm"), logs.alias("mean_log10"), F.max("tpm").alias("max_tpm")
    )


def high_in_any_sample(values: DataFrame, condition: str, cutoff: Column | float, samples: DataFrame | None = None) -> DataFrame:
    """Symbols at or above the cutoff in at least one sample of the condition, with their group mean."""
    limit = cutoff if isinstance(cutoff, Column) else F.lit(cutoff)
    return group_means(values, condition, samples).filter(F.col("max_tpm") >= limit).select("symbol", "mean_tpm")


def high_on_average(values: DataFrame, condition: str, cutoff: Column | float, samples: DataFrame | None = None) -> DataFrame:
    """Symbols whose group mean is at or above the cutoff."""
    limit = cutoff if isinstance(cutoff, Column) else F.lit(cutoff)
    return group_means(values, condition, samples).filter(F.col("mean_tpm") >= limit).select("symbol", "mean_tpm", "mean_log10")


def evidence_matrix(base: DataFrame, lists: dict[str, DataFrame], means: DataFrame) -> DataFrame:
    """Full join of an abundance list with marker lists into one boolean flag per list."""
    out = base.select("symbol").distinct().withColumn("high_abundance", F.lit(True))
    for name, table in lists.items():
        out = out.join(table.select("symbol").distinct().withColumn(name, F.lit(True)), "symbol", "full")
    flags = ["high_abundance", *lists]
    out = out.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags})
    return out.join(means, "symbol").select("symbol", F.bround("mean_tpm").alias("mean_tpm"), *flags)


def top_label(df: DataFrame, col: str, named: list[str], out: str = "label") -> DataFrame:
    return df.withColumn(out, F.when(F.col(col).isin(named), F.col(col)).otherwise("None"))


def top_mean_features(values: DataFrame, condition: str, k: int, samples: DataFrame | None = None) -> DataFrame:
    """Highest mean per-million features of one condition, ties kept."""
    return top_with_ties(group_means(values, condition, samples).select("symbol", "mean_tpm"), "mean_tpm", k)
