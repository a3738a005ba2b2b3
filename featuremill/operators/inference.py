"""Two-group tests, linear fits and overlap counts, all from grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tails import normal_two_sided, t_two_sided
from .multiple_testing import bh_adjust
from .ordered import running_sum


def linear_fit(df: DataFrame, y: str, x: str, keys: list[str] | None = None) -> DataFrame:
    """Least squares y ~ x with R squared, per key."""
    return df.groupBy(*(keys or [])).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
    )


def fitted_line(df: DataFrame, y: str, x: str) -> DataFrame:
    """Rows with their fitted value and residual."""
    slope = df.groupBy().agg(F.regr_slope(y, x).alias("v")).scalar()
    intercept = df.groupBy().agg(F.regr_intercept(y, x).alias("v")).scalar()
    return df.withColumn("fitted", intercept + slope * F.col(x)).withColumn("residual", F.col(y) - F.col("fitted"))


def rank_sum_stats(df: DataFrame, keys: list[str], value: str, group: str, first: str, second: str) -> DataFrame:
    """U of the first group and its continuity-corrected normal score z, per key.

    Ties are counted per distinct value, so mid-ranks need only running sums over distinct values.
    """
    g1, g2 = F.col(group) == first, F.col(group) == second
    counts = (
        df.filter(F.col(value).isNotNull() & (g1 | g2))
        .groupBy(*keys, value)
        .agg(F.count_if(g1).alias("a"), F.count(F.lit(1)).alias("t"))
    )
    ranked = running_sum(counts, keys, [value], {"upto": "t"})
    mid = F.col("upto") - (F.col("t") - 1) / 2.0
    sums = ranked.groupBy(*keys).agg(
        F.sum("a").alias("n1"),
        (F.sum("t") - F.sum("a")).alias("n2"),
        F.sum(F.col("a") * mid).alias("rank_sum"),
        F.sum(F.pow(F.col("t"), F.lit(3.0)) - F.col("t")).alias("ties"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2.0
    centred = F.col("u") - n1 * n2 / 2.0
    sigma = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.coalesce(F.try_divide(F.col("ties"), n * (n - 1.0)), F.lit(0.0))))
    return sums.withColumn("u", u).withColumn(
        "z", F.try_divide(centred - F.signum(centred) * 0.5, sigma)
    )


def rank_sum_test(df: DataFrame, keys: list[str], value: str, group: str, first: str, second: str) -> DataFrame:
    stats = rank_sum_stats(df, keys, value, group, first, second)
    return stats.withColumn("p", F.least(normal_two_sided("z"), F.lit(1.0))).select(*keys, "n1", "n2", "u", "z", "p")


def overlap_counts(df: DataFrame, *cols: str) -> DataFrame:
    """Number of identical points per combination, for overlap-sized marks."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def welch_stats(df: DataFrame, keys: list[str], value: str, group: str, first: str, second: str) -> DataFrame:
    """Per key: group sizes, means, Welch t with its degrees of freedom, and pooled-sd effect size."""
    def by(agg, level) -> Column:
        return agg(F.when(F.col(group) == level, F.col(value)))

    stats = df.groupBy(*keys).agg(
        *[
            by(agg, level).alias(f"{name}{i}")
            for i, level in ((1, first), (2, second))
            for name, agg in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))
        ]
    )
    return _welch_columns(stats, keys)


def welch_stats_sparse(
    df: DataFrame, keys: list[str], value: str, group: str, first: str, second: str, sizes: DataFrame
) -> DataFrame:
    """As :func:`welch_stats` with absent cells counted as zero; ``sizes`` has (group, n)."""
    def by(agg, level) -> Column:
        return agg(F.when(F.col(group) == level, F.col(value)))

    def size(level) -> Column:
        return sizes.filter(F.col(group) == level).select("n").scalar()

    stats = df.groupBy(*keys).agg(
        *[
            F.coalesce(by(agg, level), F.lit(0.0)).alias(f"{name}{i}")
            for i, level in ((1, first), (2, second))
            for name, agg in (("c", F.count), ("m", F.avg), ("v", F.var_pop))
        ]
    )
    for i, level in ((1, first), (2, second)):
        c, m, v, n = F.col(f"c{i}"), F.col(f"m{i}"), F.col(f"v{i}"), F.col(f"n{i}")
        stats = stats.withColumn(f"n{i}", size(level)).withColumn(f"mean{i}", m * c / n)
        # Centred sums of the cells there are, and of those with the zeros: no squares of large values are subtracted.
        spread = c * v + c * (n - c) / n * m * m
        stats = stats.withColumn(f"var{i}", F.try_divide(spread, n - 1))
    return _welch_columns(stats, keys)


def _welch_columns(stats: DataFrame, keys: list[str]) -> DataFrame:
    e1, e2 = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    n1, n2 = F.col("n1"), F.col("n2")
    pooled = F.sqrt(((n1 - 1) * F.col("var1") + (n2 - 1) * F.col("var2")) / (n1 + n2 - 2))
    diff = F.col("mean2") - F.col("mean1")
    return stats.select(
        *keys,
        "n1",
        "n2",
        "mean1",
        "mean2",
        F.try_divide(diff, F.sqrt(e1 + e2)).alias("t"),
        F.try_divide((e1 + e2) * (e1 + e2), e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1)).alias("dof"),
        F.try_divide(diff, pooled).alias("effect"),
    )


def with_t_p(stats: DataFrame, adjust: bool = True) -> DataFrame:
    out = stats.withColumn("p", t_two_sided("t", "dof"))
    return bh_adjust(out, "p", "padj") if adjust else out
