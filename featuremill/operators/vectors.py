"""Per-feature vectors over a fixed sample order, the input of the numeric kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_order(samples: DataFrame) -> "F.Column":
    """Sorted sample names as one array. The array is as long as a feature's vector, by definition."""
    return samples.agg(F.sort_array(F.collect_set("sample")).alias("order")).scalar()


def feature_vectors(long: DataFrame, samples: DataFrame, value: str, out: str = "k") -> DataFrame:
    """(feature, sample, value) with unique cells to (feature, array); absent cells become zero.

    Each feature gathers at most one entry per sample, so no group outgrows the sample dimension.
    """
    cells = long.groupBy("feature").agg(
        F.map_from_entries(F.collect_list(F.struct("sample", F.col(value).cast("double")))).alias("__m")
    )
    filled = F.transform("__o", lambda s: F.coalesce(F.try_element_at(F.col("__m"), s), F.lit(0.0)))
    return cells.withColumn("__o", sample_order(samples)).select("feature", filled.alias(out))


def with_design(vectors: DataFrame, samples: DataFrame, columns: list[str]) -> DataFrame:
    """Add per-sample design columns as arrays in the same sample order."""
    rows = samples.select("sample", *columns).distinct()
    packed = rows.agg(F.sort_array(F.collect_list(F.struct("sample", *columns))).alias("d")).scalar()
    return vectors.withColumn("__d", packed).withColumns({c: F.col(f"__d.{c}") for c in columns}).drop("__d")
