"""Queries on count tables: roll-up, scaling, markers, differential results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counts as C
from ..operators import markers as M
from ..operators import multiple_testing as MT
from ..operators import nbmodel as NB
from ..operators.aggregate import count_rows
from ..operators.setops import stack
from ..session import cut_lineage
from .base import (
    CONTROL, COUNTS, GENES, PART_COUNTS, PART_RESULTS, PART_TESTS, SAMPLES, TPM, TREATED,
    bh_sql, design, genes, part_counts, part_results, part_tests, query, r, rs, samples, symbol_counts,
    symbol_tpm, table,
)


@query("tpm_top_features", f"""WITH {TPM},
means AS (SELECT symbol, sum(tpm) / (SELECT count(*) FROM design WHERE condition = 'control') AS mean_tpm
  FROM tpm WHERE condition = 'control' GROUP BY 1)
SELECT symbol, {rs('mean_tpm', 3)} AS mean_tpm FROM means QUALIFY rank() OVER (ORDER BY mean_tpm DESC) <= 10""")
def tpm_top_features(spark, sf):
    top = M.top_mean_features(symbol_tpm(spark, sf), CONTROL, 10, design(spark, sf))
    return top.select("symbol", r("mean_tpm", 3).alias("mean_tpm"))


@query("gene_rollup", f"""WITH {SAMPLES}
SELECT p_brand AS gene, sample, sum(l_quantity) AS count, {rs('sum(p_size * l_extendedprice) / sum(l_extendedprice)', 6)} AS length
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN samples ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def gene_rollup(spark, sf):
    li, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    per_tx = (
        li.join(samples(spark, sf), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("l_partkey").alias("tx"), "sample")
        .agg(F.sum("l_quantity").alias("count"), F.sum("l_extendedprice").alias("abundance"))
    )
    quant = per_tx.join(part.select(F.col("p_partkey").alias("tx"), F.col("p_size").alias("length")), "tx")
    bridge = part.select(F.col("p_partkey").alias("tx"), F.col("p_brand").alias("gene"))
    return C.gene_rollup(quant, bridge).select("gene", "sample", "count", r("length").alias("length"))


@query("symbol_rollup", f"""WITH {COUNTS}
SELECT (SELECT min(id) FROM genes g WHERE g.symbol = c.feature) AS id, feature AS symbol, sample, count FROM counts c""")
def symbol_rollup(spark, sf):
    return C.merge_duplicate_symbols(part_counts(spark, sf).withColumnRenamed("feature", "id"), genes(spark, sf).select("id", "symbol"))


@query("mapping_ambiguity", f"""WITH {GENES}
SELECT 'symbol' AS side, symbol AS key, count(DISTINCT id) AS n FROM genes GROUP BY symbol HAVING count(DISTINCT id) > 1
UNION ALL SELECT 'id', CAST(id AS VARCHAR), count(DISTINCT symbol) FROM genes GROUP BY id HAVING count(DISTINCT symbol) > 1""")
def mapping_ambiguity(spark, sf):
    g = genes(spark, sf).select("id", "symbol")
    many_ids = C.symbols_with_many_ids(g).select(F.lit("symbol").alias("side"), F.col("symbol").alias("key"), F.col("ids").alias("n"))
    many_symbols = C.ids_with_many_symbols(g).select(F.lit("id").alias("side"), F.col("id").cast("string").alias("key"), F.col("symbols").alias("n"))
    return stack(many_ids, many_symbols)


@query("detected_flag", f"""WITH {SAMPLES}, known AS (SELECT p_partkey AS feature FROM part WHERE p_size <= 44),
t AS (SELECT l_partkey, sum(l_quantity) AS total FROM lineitem JOIN samples ON l_suppkey = s_suppkey JOIN known ON feature = l_partkey GROUP BY 1)
SELECT p_partkey AS feature, coalesce(total, 0.0) AS total, coalesce(total, 0.0) > 0 AS detected FROM part LEFT JOIN t ON l_partkey = p_partkey""")
def detected_flag(spark, sf):
    part = table(spark, sf, "part")
    known = part.filter("p_size <= 44").select(F.col("p_partkey").alias("feature"))  # the bridge knows only some features
    li = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "feature").join(known, "feature")
    counts = li.join(samples(spark, sf), F.col("l_suppkey") == F.col("s_suppkey")).select("feature", "sample", F.col("l_quantity").alias("count"))
    return C.detected_flag(counts, part.select(F.col("p_partkey").alias("feature")))


FACTORS = f"""{COUNTS},
complete AS (SELECT feature, avg(ln(count)) AS m FROM counts WHERE count > 0 GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM design)),
factors AS (SELECT sample, exp(median(ln(count) - m)) AS size_factor FROM counts JOIN complete USING (feature) GROUP BY 1),
norm AS (SELECT feature, sample, count, count / size_factor AS norm FROM counts JOIN factors USING (sample))"""


def stored_counts(spark, sf):
    """Symbol counts kept as a table, for queries that read them more than once."""
    return cut_lineage(symbol_counts(spark, sf))


def norm(spark, sf):
    counts = stored_counts(spark, sf)
    return C.normalized_counts(counts, C.size_factors(counts, design(spark, sf), stored=True))


@query("size_factors", f"WITH {FACTORS} SELECT sample, {rs('size_factor', 8)} AS size_factor FROM factors")
def size_factors(spark, sf):
    factors = C.size_factors(symbol_counts(spark, sf), design(spark, sf))
    return factors.select("sample", r("size_factor", 8).alias("size_factor"))


@query("base_mean", f"""WITH {FACTORS}
SELECT feature, {rs('sum(norm) / (SELECT count(*) FROM design)', 5)} AS base_mean FROM norm GROUP BY 1""")
def base_mean(spark, sf):
    return C.base_mean(norm(spark, sf), design(spark, sf)).select("feature", r("base_mean", 5).alias("base_mean"))


@query("stabilised_log", f"""WITH {FACTORS} SELECT feature, sample, {rs('log2(norm + 1.0)', 6)} AS log2_norm FROM norm""")
def stabilised_log(spark, sf):
    return C.stabilised_log(norm(spark, sf)).select("feature", "sample", r("log2_norm").alias("log2_norm"))


def nb_input(spark, sf):
    counts = stored_counts(spark, sf)
    return NB.model_input(counts, design(spark, sf), C.size_factors(counts, design(spark, sf), stored=True), TREATED)


@query("nb_dispersion")
def nb_dispersion(spark, sf):
    return NB.dispersion(nb_input(spark, sf)).select("feature", "base_mean", "disp_gene", "disp_trend", "disp")


@query("nb_wald")
def nb_wald(spark, sf):
    return MT.bh_adjust(NB.wald_test(nb_input(spark, sf)), "p", "padj")


@query("rlog")
def rlog(spark, sf):
    return NB.rlog(nb_input(spark, sf), design(spark, sf))


# Adjustment of many tests ---------------------------------------------------------------------


@query("bh_adjust", f"WITH {SAMPLES}, {PART_TESTS} SELECT feature, {rs('p', 9)} AS p, {rs('padj', 9)} AS padj FROM ({bh_sql('part_tests', 'p')})")
def bh_adjust(spark, sf):
    out = MT.bh_adjust(part_tests(spark, sf), "p", "padj")
    return out.select("feature", r("p", 9).alias("p"), r("padj", 9).alias("padj"))


GRID_STEPS = 50
_THETAS = [round(i * 0.95 / (GRID_STEPS - 1), 6) for i in range(GRID_STEPS)]
GRID = f"""thetas AS (SELECT unnest([{', '.join(map(str, _THETAS))}]::DOUBLE[]) AS theta),
tested AS (SELECT * FROM part_tests WHERE p IS NOT NULL),
cuts AS (SELECT theta, (SELECT quantile_cont(base_mean, [{', '.join(map(str, _THETAS))}]) FROM part_tests)[row_number() OVER (ORDER BY theta)] AS cutoff FROM thetas),
passing AS (SELECT theta, cutoff, p, count(*) OVER (PARTITION BY theta) AS tests, count(*) OVER (PARTITION BY theta ORDER BY p) AS rnk
  FROM cuts JOIN tested ON base_mean >= cutoff),
grid AS (SELECT theta, any_value(cutoff) AS cutoff, any_value(tests) AS tests,
  coalesce(max(CASE WHEN p * tests <= 0.05 * rnk THEN rnk END), 0) AS rejections FROM passing GROUP BY theta)"""


@query("filter_grid", f"WITH {SAMPLES}, {PART_TESTS}, {GRID} SELECT theta, {rs('cutoff', 6)} AS cutoff, tests, rejections FROM grid")
def filter_grid(spark, sf):
    grid = MT.filter_grid(part_tests(spark, sf), 0.05, GRID_STEPS)
    return grid.select("theta", r("cutoff").alias("cutoff"), "tests", "rejections")


@query("independent_filter", f"""WITH {SAMPLES}, {PART_TESTS}, {GRID},
best AS (SELECT cutoff FROM grid ORDER BY rejections DESC, theta LIMIT 1),
kept AS (SELECT feature, base_mean, p, CASE WHEN base_mean >= (SELECT cutoff FROM best) THEN p END AS pk FROM part_tests)
SELECT feature, {rs('base_mean', 6)} AS base_mean, {rs('p', 9)} AS p, {rs('padj', 9)} AS padj FROM ({bh_sql('kept', 'pk')})""")
def independent_filter(spark, sf):
    out = MT.independent_filter(part_tests(spark, sf), 0.05, GRID_STEPS)
    return out.select("feature", r("base_mean").alias("base_mean"), r("p", 9).alias("p"), r("padj", 9).alias("padj"))


WEIGHTED = f"""tiled AS (SELECT *, ntile(10) OVER (ORDER BY base_mean, feature) AS tile FROM part_tests),
pw AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, p / (tile / 5.5)) END AS pw FROM tiled)"""


def _tile_weighted(spark, sf):
    tiled = MT.ntile(part_tests(spark, sf), ["base_mean", "feature"], 10)
    return tiled.withColumn("weight", F.col("tile") / F.lit(5.5))


@query("weighted_bh", f"""WITH {SAMPLES}, {PART_TESTS}, {WEIGHTED}
SELECT feature, tile, {rs('padj', 9)} AS padj FROM ({bh_sql('pw', 'pw')})""")
def weighted_bh(spark, sf):
    out = MT.weighted_bh(_tile_weighted(spark, sf), "p", "weight")
    return out.select("feature", F.col("tile").cast("long").alias("tile"), r("padj", 9).alias("padj"))


@query("ihw_learned")
def ihw_learned(spark, sf):
    return MT.ihw(part_tests(spark, sf), tiles=5, folds=5, alpha=0.05)


@query("rejection_counts", f"""WITH {SAMPLES}, {PART_TESTS}, {WEIGHTED},
a AS ({bh_sql('pw', 'p', 'plain')}), b AS ({bh_sql('a', 'pw', 'weighted')})
SELECT count(*) FILTER (WHERE plain <= 0.05) AS plain, count(*) FILTER (WHERE weighted <= 0.05) AS weighted FROM b""")
def rejection_counts(spark, sf):
    both = MT.weighted_bh(MT.bh_adjust(_tile_weighted(spark, sf), "p", "plain"), "p", "weight", "weighted")
    return MT.rejection_counts(both, 0.05, plain="plain", weighted="weighted")


# Differential results -------------------------------------------------------------------------


@query("combine_results", f"""WITH {PART_RESULTS}, {WEIGHTED},
adjusted AS MATERIALIZED (SELECT feature, padj AS weighted_padj FROM ({bh_sql('pw', 'pw')})),
tests AS MATERIALIZED (SELECT feature, padj, log2fc, weighted_padj FROM results JOIN adjusted USING (feature)),
cells AS MATERIALIZED (SELECT feature, sample, count FROM part_counts),
groups AS MATERIALIZED (SELECT list({{'sample': sample, 'condition': condition}}) AS g FROM design),
grid AS MATERIALIZED (SELECT feature, padj, log2fc, weighted_padj, unnest((SELECT g FROM groups), recursive := true) FROM tests)
SELECT feature, sample, condition, coalesce(count, 0.0) AS count, {rs('padj', 9)} AS padj, {rs('weighted_padj', 9)} AS weighted_padj, {rs('log2fc', 6)} AS log2fc,
  {rs('log2(coalesce(count, 0.0) + 1.0)', 6)} AS log2_count FROM grid LEFT JOIN cells USING (feature, sample)""")
def combine_results(spark, sf):
    counts = part_counts(spark, sf)
    logged = counts.select("feature", "sample", F.log2(F.col("count") + 1.0).alias("log2_count"))
    weighted = MT.weighted_bh(_tile_weighted(spark, sf), "p", "weight", "weighted_padj").select("feature", "weighted_padj")
    tests = part_results(spark, sf).join(weighted, "feature")
    out = C.combine_results(tests, counts, logged, design(spark, sf), {"log2_count": 0.0})
    return out.select(
        "feature", "sample", "condition", "count", r("padj", 9).alias("padj"), r("weighted_padj", 9).alias("weighted_padj"), r("log2fc").alias("log2fc"),
        r("log2_count").alias("log2_count"),
    )


@query("combine_transformed")
def combine_transformed(spark, sf):
    """The long table of the fitted model: its tests, both adjustments, and regularised values of every sample."""
    counts = stored_counts(spark, sf)
    model = cut_lineage(NB.model_input(counts, design(spark, sf), C.size_factors(counts, design(spark, sf), stored=True), TREATED))
    tests = cut_lineage(NB.wald_test(model).select("feature", "base_mean", "log2fc", "count_outlier", "p"))
    weighted = MT.ihw(tests, tiles=5, folds=5, alpha=0.05, out="weighted_padj").select("feature", "weighted_padj")
    adjusted = MT.independent_filter(tests).join(weighted, "feature")
    return C.combine_results(adjusted, counts, NB.rlog(model, design(spark, sf)), design(spark, sf))


@query("volcano_table", f"""WITH {PART_RESULTS},
v AS (SELECT feature, coalesce(padj, 1.0) AS padj, least(greatest(coalesce(log2fc, 0.0), -1.0), 1.0) AS log2fc FROM results)
SELECT feature, {rs('padj', 9)} AS padj, {rs('log2fc', 6)} AS log2fc,
  CASE WHEN log2fc > 0 AND padj < 0.05 THEN 'up' WHEN log2fc < 0 AND padj < 0.05 THEN 'down' ELSE 'neither' END AS regulation,
  {rs('-log10(padj)', 6)} AS neg_log10_padj, CASE WHEN abs(log2fc) > 0.5 AND padj < 0.05 THEN CAST(feature AS VARCHAR) END AS label FROM v""")
def volcano_table(spark, sf):
    out = C.volcano_table(part_results(spark, sf), 0.05, bound=1.0, label_above=0.5)
    return out.select(
        "feature", r("padj", 9).alias("padj"), r("log2fc").alias("log2fc"), "regulation", r("neg_log10_padj").alias("neg_log10_padj"), "label"
    )


@query("fc_tiers", f"""WITH {PART_RESULTS}, h AS (SELECT log2fc FROM results WHERE padj < 0.05)
SELECT 'all' AS tier, count(*) AS n FROM h UNION ALL SELECT 'up', count(*) FROM h WHERE log2fc > 0
UNION ALL SELECT 'down', count(*) FROM h WHERE log2fc < 0 UNION ALL SELECT 'abs>0.25', count(*) FROM h WHERE abs(log2fc) > 0.25
UNION ALL SELECT 'abs>0.5', count(*) FROM h WHERE abs(log2fc) > 0.5 UNION ALL SELECT 'abs>1', count(*) FROM h WHERE abs(log2fc) > 1""")
def fc_tiers(spark, sf):
    return C.fold_change_tiers(C.significant(part_results(spark, sf)), (0.25, 0.5, 1.0))


@query("smallest_padj", f"""WITH {PART_RESULTS} SELECT feature, {rs('padj', 9)} AS padj FROM results WHERE padj IS NOT NULL QUALIFY rank() OVER (ORDER BY padj) <= 10""")
def smallest_padj(spark, sf):
    from ..operators.ordered import top_with_ties

    return top_with_ties(part_results(spark, sf), "padj", 10, largest=False).select("feature", r("padj", 9).alias("padj"))


@query("group_mean_wide", f"""WITH {COUNTS}
SELECT feature, {rs("sum(CASE WHEN condition = 'control' THEN count ELSE 0 END) / (SELECT count(*) FROM design WHERE condition = 'control')", 6)} AS control,
  {rs("sum(CASE WHEN condition = 'treated' THEN count ELSE 0 END) / (SELECT count(*) FROM design WHERE condition = 'treated')", 6)} AS treated
FROM counts JOIN design USING (sample) GROUP BY 1""")
def group_mean_wide(spark, sf):
    wide = C.group_mean_wide(symbol_counts(spark, sf), design(spark, sf), "count", [CONTROL, TREATED])
    return wide.select("feature", r("control").alias("control"), r("treated").alias("treated"))


# Markers --------------------------------------------------------------------------------------

CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL"]


def _marker_symbol(col):
    return F.floor(F.col(col) / 2).cast("long").alias("symbol")


def marker_database(spark, sf):
    """Two rows per symbol: category from the type, organ from the brand's parity of size."""
    organ = F.when(F.col("p_size") % 2 == 0, "organ A").otherwise("organ B")
    species = F.when(F.col("p_size") % 3 == 0, "Mm").when(F.col("p_size") % 3 == 1, "Mm Hs").otherwise("Hs")
    return table(spark, sf, "part").select(
        _marker_symbol("p_partkey"), F.col("p_type").alias("category"), organ.alias("organ"), species.alias("species"),
        F.when(F.col("p_size") % 4 != 0, 1).alias("canonical"), F.when(F.col("p_size") <= 45, F.col("p_retailprice") - 960.0).alias("specificity"),
    )


def curated_markers(spark, sf):
    organ = F.when(F.col("p_size") % 2 == 0, "organ A").otherwise("organ B")
    """A list made by hand: the small parts."""
    return table(spark, sf, "part").filter("p_size <= 4").select(
        _marker_symbol("p_partkey"), F.col("p_type").alias("category"), organ.alias("organ")
    ).distinct()


def specific_markers(spark, sf):
    return M.specific_markers(
        marker_database(spark, sf), curated_markers(spark, sf), CATEGORIES, ["Mm", "Mm Hs"], exempt=[7], drop_pairs=[(3, "SMALL"), (7, "PROMO")]
    )


_ORGAN = "CASE WHEN p_size % 2 = 0 THEN 'organ A' ELSE 'organ B' END"
_CATS = ", ".join(f"'{c}'" for c in CATEGORIES)
MARKERS = f"""db AS (SELECT p_partkey // 2 AS symbol, p_type AS category, {_ORGAN} AS organ,
  CASE p_size % 3 WHEN 0 THEN 'Mm' WHEN 1 THEN 'Mm Hs' ELSE 'Hs' END AS species,
  CASE WHEN p_size % 4 <> 0 THEN 1 END AS canonical, CASE WHEN p_size <= 45 THEN p_retailprice - 960.0 END AS specificity FROM part),
curated AS (SELECT DISTINCT p_partkey // 2 AS symbol, p_type AS category, {_ORGAN} AS organ
  FROM part WHERE p_size <= 4),
ambiguous AS (SELECT symbol FROM db FULL JOIN curated USING (symbol, category, organ)
  WHERE symbol <> 7 AND category IN ({_CATS}) GROUP BY 1 HAVING count(*) <> 1),
markers AS (SELECT symbol, category, organ, canonical, specificity FROM
  (SELECT * FROM db WHERE canonical = 1 AND NOT specificity > 0 AND species IN ('Mm', 'Mm Hs')) FULL JOIN curated USING (symbol, category, organ)
  WHERE NOT (symbol = 3 AND category = 'SMALL') AND NOT (symbol = 7 AND category = 'PROMO')
  AND category IN ({_CATS}) AND symbol NOT IN (SELECT symbol FROM ambiguous))"""
MARKER_TPM = f"""{SAMPLES},
mc AS (SELECT l_partkey // 2 AS symbol, sample, sum(l_quantity) AS count FROM lineitem JOIN samples ON l_suppkey = s_suppkey GROUP BY 1, 2),
ml AS (SELECT p_partkey // 2 AS symbol, avg(p_size) * 100.0 AS length FROM part GROUP BY 1),
mr AS (SELECT symbol, sample, count / (length / 1000.0) AS rpk FROM mc JOIN ml USING (symbol)),
tpm AS (SELECT symbol, sample, condition, rpk / (sum(rpk) OVER (PARTITION BY sample) / 1e6) AS tpm FROM mr JOIN design USING (sample)),
means AS (SELECT symbol, sum(tpm) / (SELECT count(*) FROM design WHERE condition = 'control') AS mean_tpm, max(tpm) AS max_tpm
  FROM tpm WHERE condition = 'control' GROUP BY 1)"""


def marker_tpm(spark, sf):
    counts = part_counts(spark, sf).groupBy(F.floor(F.col("feature") / 2).cast("long").alias("feature"), "sample").agg(F.sum("count").alias("count"))
    lengths = table(spark, sf, "part").groupBy(F.floor(F.col("p_partkey") / 2).cast("long").alias("feature")).agg((F.avg("p_size") * 100.0).alias("length"))
    return C.tpm(counts, lengths).join(design(spark, sf), "sample").withColumnRenamed("feature", "symbol")


@query("marker_specificity", f"WITH {MARKERS} SELECT symbol, category, organ, canonical, {rs('specificity', 4)} AS specificity FROM markers")
def marker_specificity(spark, sf):
    return specific_markers(spark, sf).select("symbol", "category", "organ", "canonical", r("specificity", 4).alias("specificity"))


@query("category_expression", f"""WITH {MARKERS}, {MARKER_TPM},
j AS (SELECT DISTINCT category, symbol, sample, condition, tpm FROM markers JOIN tpm USING (symbol))
SELECT category, symbol, sample, condition, {rs('tpm', 4)} AS tpm, {rs('log10(tpm)', 6)} AS tpm_log10, {rs('log2(tpm)', 6)} AS tpm_log2,
  {rs('sum(tpm) OVER (PARTITION BY category) / (symbols * (SELECT count(*) FROM design))', 4)} AS mean_category_tpm
  FROM j JOIN (SELECT category, count(DISTINCT symbol) AS symbols FROM j GROUP BY 1) USING (category)""")
def category_expression(spark, sf):
    out = M.category_expression(specific_markers(spark, sf), marker_tpm(spark, sf), design(spark, sf))
    return out.select(
        "category", "symbol", "sample", "condition", r("tpm", 4).alias("tpm"), r("tpm_log10").alias("tpm_log10"),
        r("tpm_log2").alias("tpm_log2"), r("mean_category_tpm", 4).alias("mean_category_tpm"),
    )


@query("markers_in_hits", f"""WITH {MARKERS}, {SAMPLES}, {PART_TESTS},
hits AS (SELECT DISTINCT feature // 2 AS symbol FROM ({bh_sql('part_tests', 'p')}) WHERE padj < 0.05),
pairs AS (SELECT DISTINCT category, symbol FROM markers)
SELECT category, count(*) FILTER (WHERE symbol IN (SELECT symbol FROM hits)) AS hits, count(*) AS markers FROM pairs GROUP BY 1 HAVING hits > 0""")
def markers_in_hits(spark, sf):
    hits = MT.bh_adjust(part_tests(spark, sf)).filter("padj < 0.05").select(F.floor(F.col("feature") / 2).cast("long").alias("symbol"))
    return M.markers_in_hits(specific_markers(spark, sf), hits)


ANCHOR = """anchor AS (SELECT coalesce(min(tpm), 0.0) AS m FROM tpm WHERE symbol = (SELECT min(symbol) FROM
  (SELECT symbol FROM tpm GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM design))))"""


def anchor_of(values, spark, sf):
    """Smallest value of an anchor that every sample has; zero when there is none."""
    samples_ = design(spark, sf)
    return F.coalesce(M.anchor_minimum(values, M.complete_symbol(values, samples_), samples_), F.lit(0.0))


@query("high_abundance_anchor", f"""WITH {MARKER_TPM}, {ANCHOR}
SELECT 'fixed' AS variant, symbol, {rs('mean_tpm', 4)} AS mean_tpm FROM means WHERE max_tpm >= 4000.0
UNION ALL SELECT 'any', symbol, {rs('mean_tpm', 4)} FROM means WHERE max_tpm >= (SELECT m FROM anchor)
UNION ALL SELECT 'mean', symbol, {rs('mean_tpm', 4)} FROM means WHERE mean_tpm >= (SELECT m FROM anchor)""")
def high_abundance_anchor(spark, sf):
    values = cut_lineage(marker_tpm(spark, sf))
    anchor, groups = anchor_of(values, spark, sf), design(spark, sf)
    parts = {
        "fixed": M.high_in_any_sample(values, CONTROL, 4000.0, groups),
        "any": M.high_in_any_sample(values, CONTROL, anchor, groups),
        "mean": M.high_on_average(values, CONTROL, anchor, groups),
    }
    return stack(*[t.select(F.lit(n).alias("variant"), "symbol", r("mean_tpm", 4).alias("mean_tpm")) for n, t in parts.items()])


@query("evidence_matrix", f"""WITH {MARKERS}, {MARKER_TPM}, {ANCHOR},
high AS (SELECT symbol, true AS high_abundance FROM means WHERE mean_tpm >= (SELECT m FROM anchor)),
d AS (SELECT DISTINCT symbol, true AS database_marker FROM db WHERE category = 'SMALL' AND contains(species, 'Mm')),
c AS (SELECT DISTINCT symbol, true AS curated_marker FROM curated WHERE category = 'SMALL')
SELECT symbol, round_even(mean_tpm, 0) AS mean_tpm, coalesce(high_abundance, false) AS high_abundance, coalesce(database_marker, false) AS database_marker,
  coalesce(curated_marker, false) AS curated_marker, CASE WHEN symbol IN (11, 12, 13) THEN CAST(symbol AS VARCHAR) ELSE 'None' END AS label
FROM high FULL JOIN d USING (symbol) FULL JOIN c USING (symbol) JOIN means USING (symbol)""")
def evidence_matrix(spark, sf):
    values = cut_lineage(marker_tpm(spark, sf))
    high = M.high_on_average(values, CONTROL, anchor_of(values, spark, sf), design(spark, sf))
    lists = {
        "database_marker": marker_database(spark, sf).filter((F.col("category") == "SMALL") & F.col("species").contains("Mm")),
        "curated_marker": curated_markers(spark, sf).filter(F.col("category") == "SMALL"),
    }
    out = M.evidence_matrix(high, lists, M.group_means(values, CONTROL, design(spark, sf)).select("symbol", "mean_tpm"))
    return M.top_label(out.withColumn("__s", F.col("symbol").cast("string")), "__s", ["11", "12", "13"]).drop("__s")


@query("markers_per_category", f"WITH {MARKERS} SELECT category, count(DISTINCT symbol) AS n FROM markers GROUP BY 1")
def markers_per_category(spark, sf):
    return M.markers_per_category(specific_markers(spark, sf))


@query("sample_census", f"WITH {PART_COUNTS} SELECT sample, count(*) AS n FROM part_counts GROUP BY 1")
def sample_census(spark, sf):
    return count_rows(part_counts(spark, sf), "sample")
