"""Count tables in long form (feature, sample, count): roll-up, size factors, per-million scaling.

A cell that is absent counts as zero; no feature x sample grid is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .aggregate import repeated_keys, with_group_stats
from .joins import first_per_key
from .ordered import median_by


def gene_rollup(quant: DataFrame, bridge: DataFrame) -> DataFrame:
    """Transcript rows (tx, sample, count, abundance, length) to gene totals per sample.

    The gene length is the abundance-weighted mean transcript length, or the plain mean where the
    abundance is zero throughout.
    """
    weight = F.sum("abundance")
    return (
        quant.join(bridge, "tx")
        .groupBy("gene", "sample")
        .agg(
            F.sum("count").alias("count"),
            weight.alias("abundance"),
            F.coalesce(F.try_divide(F.sum(F.col("length") * F.col("abundance")), weight), F.avg("length")).alias("length"),
        )
    )


def merge_duplicate_symbols(counts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Sum counts over ids that share a symbol; the smallest id represents the symbol.

    counts(id, sample, count) and symbols(id, symbol) give (id, symbol, sample, count).
    """
    totals = counts.join(symbols.distinct(), "id").groupBy("symbol", "sample").agg(F.sum("count").alias("count"))
    representative = first_per_key(symbols.select("symbol", "id"), ["symbol"], ["id"])
    return totals.join(representative, "symbol").select("id", "symbol", "sample", "count")


def symbols_with_many_ids(symbols: DataFrame) -> DataFrame:
    return repeated_keys(symbols.select("id", "symbol").distinct(), "symbol", name="ids")


def ids_with_many_symbols(symbols: DataFrame) -> DataFrame:
    return repeated_keys(symbols.select("id", "symbol").distinct(), "id", name="symbols")


def detected_flag(counts: DataFrame, features: DataFrame) -> DataFrame:
    """Every known feature with its total and whether that total is above zero."""
    totals = counts.groupBy("feature").agg(F.sum("count").alias("total"))
    return (
        features.select("feature")
        .distinct()
        .join(totals, "feature", "left")
        .select("feature", F.coalesce("total", F.lit(0.0)).alias("total"))
        .withColumn("detected", F.col("total") > 0)
    )


def size_factors(counts: DataFrame, samples: DataFrame, stored: bool = False) -> DataFrame:
    """Median over features of count / geometric mean, from features counted in every sample.

    The per-sample median runs over all features, hence the range-partitioned quantile. The counts
    are read twice (means, then ratios), so they are stored instead of aggregated twice, unless the caller has ``stored`` them.
    """
    counts = counts if stored else cut_lineage(counts)
    n = samples.select("sample").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    positive = counts.filter(F.col("count") > 0)
    means = positive.groupBy("feature").agg(F.avg(F.log("count")).alias("log_mean"), F.count(F.lit(1)).alias("seen"))
    complete = means.filter(F.col("seen") == n).select("feature", "log_mean")
    ratios = positive.join(complete, "feature").select("sample", (F.log("count") - F.col("log_mean")).alias("log_ratio"))
    return median_by(ratios, ["sample"], "log_ratio", "m").select("sample", F.exp("m").alias("size_factor"))


def normalized_counts(counts: DataFrame, factors: DataFrame) -> DataFrame:
    return counts.join(factors, "sample").withColumn("norm", F.col("count") / F.col("size_factor"))


def base_mean(norm: DataFrame, samples: DataFrame) -> DataFrame:
    """Mean normalised count per feature over all samples, absent cells counted as zero."""
    n = samples.select("sample").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return norm.groupBy("feature").agg(F.sum("norm").alias("total")).select(
        "feature", (F.col("total") / n).alias("base_mean")
    )


def stabilised_log(norm: DataFrame) -> DataFrame:
    """log2(normalised count + 1)."""
    return norm.withColumn("log2_norm", F.log2(F.col("norm") + 1.0))


def tpm(counts: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per-million values: reads per kilobase, scaled so that each sample sums to one million."""
    rpk = counts.join(lengths, "feature").withColumn("rpk", F.col("count") / (F.col("length") / 1000.0))
    scaled = with_group_stats(rpk, ["sample"], scaling_factor=F.sum("rpk") / 1e6)
    return scaled.withColumn("tpm", F.try_divide(F.col("rpk"), F.col("scaling_factor")))


def group_mean_wide(values: DataFrame, samples: DataFrame, value: str, levels: list[str]) -> DataFrame:
    """Mean per feature and condition, one column per condition, absent cells counted as zero.

    Summed per feature and condition in one aggregate, then divided by the condition's sample count.
    """
    sizes = samples.select("sample", "condition").distinct()
    def one(level: str) -> Column:
        n = sizes.filter(F.col("condition") == level).agg(F.count(F.lit(1)).alias("n")).scalar()
        return F.coalesce(F.sum(F.when(F.col("condition") == level, F.col(value))), F.lit(0.0)) / n

    return values.join(sizes, "sample").groupBy("feature").agg(*[one(v).alias(v) for v in levels])


def combine_results(tests: DataFrame, counts: DataFrame, transformed: DataFrame, samples: DataFrame, absent: dict[str, float] | None = None) -> DataFrame:
    """Test results of every feature with counts, transformed values and condition of every sample, in long form.

    The output has a row per feature and sample, so the (few) samples travel as one array that each
    test row unfolds. An absent cell counts zero; ``absent`` says what its transformed values are.
    """
    every = samples.select("sample", "condition").distinct().agg(F.sort_array(F.collect_list(F.struct("sample", "condition"))).alias("s")).scalar()
    grid = tests.withColumn("__s", F.explode(every)).withColumns({"sample": F.col("__s.sample"), "condition": F.col("__s.condition")}).drop("__s")
    cells = counts.select("feature", "sample", "count").join(transformed, ["feature", "sample"], "left")
    fill = {"count": 0.0, **(absent or {})}
    return grid.join(cells, ["feature", "sample"], "left").na.fill(fill)


def two_group_log_ratio(wide: DataFrame, treated: str, control: str, pseudo: float = 1.0) -> DataFrame:
    return wide.withColumn(
        "log2fc", F.log2((F.col(treated) + pseudo) / (F.col(control) + pseudo))
    )


def volcano_table(results: DataFrame, alpha: float = 0.05, bound: float = 8.0, label_above: float = 2.0) -> DataFrame:
    """(feature, padj, log2fc) with missing values set to 1 and 0, clamped change, class and label."""
    lfc = F.least(F.greatest(F.coalesce("log2fc", F.lit(0.0)), F.lit(-bound)), F.lit(bound))
    padj = F.coalesce("padj", F.lit(1.0))
    out = results.select("feature", padj.alias("padj"), lfc.alias("log2fc"))
    hit = F.col("padj") < alpha
    return out.withColumns(
        {
            "regulation": F.when((F.col("log2fc") > 0) & hit, "up")
            .when((F.col("log2fc") < 0) & hit, "down")
            .otherwise("neither"),
            "neg_log10_padj": -F.log10("padj"),
            "label": F.when((F.abs("log2fc") > label_above) & hit, F.col("feature").cast("string")),
        }
    )


def significant(results: DataFrame, alpha: float = 0.05) -> DataFrame:
    return results.filter(F.col("padj") < alpha)


def fold_change_tiers(hits: DataFrame, tiers: tuple[float, ...] = (2.0, 3.0, 4.0)) -> DataFrame:
    """Hits, up, down, and hits above each absolute fold change, in one pass, as (tier, n)."""
    lfc = F.col("log2fc")
    tests = {"all": F.lit(True), "up": lfc > 0, "down": lfc < 0}
    tests.update({f"abs>{t:g}": F.abs(lfc) > t for t in tiers})
    rows = [F.struct(F.lit(n).alias("tier"), F.count_if(c).alias("n")) for n, c in tests.items()]
    return hits.agg(F.array(*rows).alias("r")).select(F.inline("r"))
