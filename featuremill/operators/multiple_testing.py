"""Adjustment of p-values over many tests, without sorting all tests in one task."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .aggregate import with_group_stats
from .ordered import following_min, ntile, quantiles_by, running_sum, store_by_range

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def bh_adjust(df: DataFrame, p: str = "p", out: str = "padj", keys: list[str] | None = None, stored: bool = False) -> DataFrame:
    """Step-up adjusted p: running minimum, from the largest p, of p * n / rank (ties: highest rank).

    Works on distinct p-values with their counts; a missing p stays missing and is not counted. The
    rows are stored first, so that the join back meets bit-identical p-values; ``stored`` says that they are.
    """
    keys = keys or []
    df = df if stored else cut_lineage(df)
    known = df.filter(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count(F.lit(1)).alias("__n"))
    stored = store_by_range(known, keys, [p])
    ranked = running_sum(stored, keys, [p], {"__rank": "__n"}, stored=True)
    total = known.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    ranked = ranked.join(total, keys) if keys else ranked.withColumn("__total", total.scalar())
    raw = ranked.withColumn("__raw", F.col(p) * F.col("__total") / F.col("__rank"))
    adjusted = following_min(raw, keys, [p], "__raw", out).select(*keys, p, F.least(out, F.lit(1.0)).alias(out))
    # Rows without a p need no join, and would share one key in it.
    none = df.filter(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double"))
    return df.filter(F.col(p).isNotNull()).join(adjusted, [*keys, p], "left").select(*df.columns, out).unionByName(none)


def weighted_bh(df: DataFrame, p: str, weight: str, out: str = "padj") -> DataFrame:
    """Step-up adjustment of p / weight; a zero weight can never be rejected (adjusted p = 1)."""
    scaled = df.withColumn(
        "__pw", F.when(F.col(p).isNotNull(), F.least(F.coalesce(F.try_divide(F.col(p), F.col(weight)), F.lit(1.0)), F.lit(1.0)))
    )
    return bh_adjust(scaled, "__pw", out).drop("__pw")


def rejection_counts(df: DataFrame, alpha: float, **columns: str) -> DataFrame:
    """Number of rejections under several adjustments, as one row."""
    return df.agg(*[F.count_if(F.col(c) <= alpha).alias(n) for n, c in columns.items()])


def filter_grid(df: DataFrame, alpha: float = 0.05, steps: int = 50, stored: bool = False) -> DataFrame:
    """Rejections at ``alpha`` for each mean cutoff; df(feature, base_mean, p) gives (theta, cutoff, rejections).

    Only tests with p <= alpha can be rejected, so only those are repeated over the (at most
    ``steps``) cutoffs they pass; the number of tests per cutoff comes from a histogram. The cutoffs themselves
    (``steps`` numbers) pass through the driver.
    """
    df = df.select("base_mean", "p") if stored else cut_lineage(df.select("base_mean", "p"))
    thetas = [round(i * 0.95 / (steps - 1), 6) for i in range(steps)]
    cuts = quantiles_by(df, [], "base_mean", {f"q{i}": t for i, t in enumerate(thetas)}).first()
    grid = F.array(*[F.lit(cuts[f"q{i}"]) for i in range(steps)])
    passed = F.size(F.filter(F.col("cuts"), lambda c: c <= F.col("base_mean")))
    tests = df.filter(F.col("p").isNotNull()).withColumn("cuts", grid).select("p", passed.alias("passed"))
    sizes = (
        tests.groupBy("passed")
        .agg(F.count(F.lit(1)).alias("m"))
        .select(F.explode(F.sequence(F.lit(1), F.col("passed"))).alias("step"), "m")
        .groupBy("step")
        .agg(F.sum("m").alias("tests"))
    )
    candidates = (
        tests.filter(F.col("p") <= alpha)
        .select(F.explode(F.sequence(F.lit(1), F.col("passed"))).alias("step"), "p")
        .groupBy("step", "p")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = running_sum(candidates, ["step"], ["p"], {"rank": "n"}).join(sizes, "step")
    rejected = ranked.filter(F.col("p") * F.col("tests") <= alpha * F.col("rank")).groupBy("step").agg(
        F.max("rank").alias("rejections")
    )
    theta = F.element_at(F.array(*[F.lit(t) for t in thetas]), F.col("step"))
    return sizes.join(rejected, "step", "left").select(
        theta.alias("theta"),
        F.element_at(grid, F.col("step")).alias("cutoff"),
        "tests",
        F.coalesce("rejections", F.lit(0)).cast("long").alias("rejections"),
    )


def independent_filter(df: DataFrame, alpha: float = 0.05, steps: int = 50) -> DataFrame:
    """Adjusted p after dropping features below the mean cutoff with most rejections (ties: lowest cutoff).

    Dropped features keep their p and get a missing adjusted p.
    """
    df = cut_lineage(df)
    grid = filter_grid(df, alpha, steps, stored=True)
    best = grid.agg(F.max_by("cutoff", F.struct("rejections", -F.col("theta"))).alias("cutoff")).first()["cutoff"]
    tested = df.withColumn("__p", F.when(F.col("base_mean") >= F.lit(best), F.col("p")))
    return bh_adjust(tested, "__p", "padj", stored=True).drop("__p")


# Learned weights -----------------------------------------------------------------------------

_CELLS = 200


def _concave_slopes(edges: np.ndarray, heights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least concave majorant of an empirical distribution: kept knots and their right-hand slopes."""
    keep = [0]
    for i in range(1, len(edges)):
        while len(keep) > 1:
            a, b = keep[-2], keep[-1]
            if (heights[b] - heights[a]) * (edges[i] - edges[b]) <= (heights[i] - heights[b]) * (edges[b] - edges[a]):
                keep.pop()
            else:
                break
        keep.append(i)
    k = np.array(keep)
    return k, np.diff(heights[k]) / np.diff(edges[k])


#: Strengths of the penalty that inner folds choose from; the last gives every tile the same weight.
PENALTIES = (0.0, 0.125, 0.25, 0.5, 1.0, 2.0, math.inf)
_EDGES = np.concatenate([[0.0], 10.0 ** np.linspace(-8, 0, _CELLS)])


def _concave(counts: np.ndarray) -> np.ndarray:
    """Least concave distribution above the empirical one of each tile, at the edges of the cells: (tiles, edges)."""
    out = []
    for h in counts:
        heights = np.concatenate([[0.0], np.cumsum(h) / max(h.sum(), 1.0)])
        knots, _ = _concave_slopes(_EDGES, heights)
        out.append(np.interp(_EDGES, _EDGES[knots], heights[knots]))
    return np.stack(out)


def penalised_thresholds(gain: np.ndarray, edges: np.ndarray, cost: float) -> np.ndarray:
    """Index of the threshold of each tile that maximises the sum of ``gain`` less ``cost`` x the total variation of the thresholds, tile after tile.

    Exact, by dynamic programming over the edges. An infinite cost gives every tile the same threshold. Ties go to smaller ones.
    """
    if math.isinf(cost):
        return np.full(len(gain), int(gain.sum(0).argmax()))
    jump = cost * np.abs(edges[:, None] - edges[None, :])
    best, back = gain[0], []
    for g in gain[1:]:
        ways = best[None, :] - jump
        back.append(ways.argmax(1))
        best = g + ways.max(1)
    at = [int(best.argmax())]
    for b in reversed(back):
        at.append(int(b[at[-1]]))
    return np.array(at[::-1])


def tile_weights(counts: np.ndarray, alpha: float, penalty: float) -> np.ndarray:
    """Weights of the tiles, one on average over the tests, from histograms (tiles, cells) of their p-values.

    The thresholds have the most expected rejections, less the penalty on their total variation, among those whose expected false share is
    alpha at most: at the multiplier of the false tests for which it just is. Multipliers below one are out of the search: p-values are no
    denser there than under no effect.
    """
    f, m = _concave(counts), counts.sum(1)
    low, high = 0.0, 10.0

    def at(power: float) -> np.ndarray:
        slope = 10.0**power
        return penalised_thresholds(m[:, None] * (f - slope * _EDGES[None, :]), _EDGES, penalty if math.isinf(penalty) else penalty * slope * m.mean())

    rows = np.arange(len(m))
    for _ in range(40):
        mid = (low + high) / 2
        t = at(mid)
        if (m * _EDGES[t]).sum() <= alpha * (m * f[rows, t]).sum():
            high = mid
        else:
            low = mid
    t = _EDGES[at(high)]
    total = (m * t).sum()
    return t * m.sum() / total if total > 0 else np.ones(len(m))


def histogram_rejections(counts: np.ndarray, weights: np.ndarray, alpha: float) -> int:
    """Rejections of the weighted step-up among tests known by their cells; a test has the p-value of its cell's upper edge."""
    m = counts.sum(1)
    scale = (weights * m).sum() / max(m.sum(), 1.0)
    w = weights / scale if scale > 0 else np.ones(len(weights))
    with np.errstate(divide="ignore"):
        p = np.where(w[:, None] > 0, _EDGES[None, 1:] / np.maximum(w[:, None], 1e-300), np.inf).ravel()
    order = np.argsort(p, kind="stable")
    rank = np.cumsum(counts.ravel()[order])
    ok = p[order] * m.sum() <= alpha * rank
    return int(rank[ok].max()) if ok.any() else 0


def choose_penalty(by_fold: dict[int, np.ndarray], alpha: float) -> float:
    """The strongest penalty that is not worse than the best one by more than chance.

    A penalty's score is what weights learned on all folds but one reject on that one, summed over the folds; the square root of the
    best score is taken as its standard error, so that differences without a signal keep the weights equal. A single fold scores itself.
    """
    scores = []
    for penalty in PENALTIES:
        n = 0
        for f, held in by_fold.items():
            rest = [h for g, h in by_fold.items() if g != f] or [held]
            n += histogram_rejections(held, tile_weights(np.sum(rest, axis=0), alpha, penalty), alpha)
        scores.append(n)
    good = max(scores) - math.sqrt(max(scores))
    return max(penalty for n, penalty in zip(scores, PENALTIES) if n >= good)


def _learn(pdf: pd.DataFrame, alpha: float) -> pd.DataFrame:
    """Weights per tile for one fold, from bounded histograms of the other folds, which also choose the penalty."""
    tiles, by_fold = sorted(pdf["tile"].unique()), {}
    place = {t: i for i, t in enumerate(tiles)}
    for f, part in pdf.groupby("inner"):
        h = np.zeros((len(tiles), _CELLS))
        np.add.at(h, (part["tile"].map(place).to_numpy(), part["cell"].to_numpy()), part["n"].to_numpy(dtype=float))
        by_fold[int(f)] = h
    penalty = choose_penalty(by_fold, alpha)
    weights = tile_weights(np.sum(list(by_fold.values()), axis=0), alpha, penalty)
    return pd.DataFrame({"fold": int(pdf["fold"].iloc[0]), "tile": tiles, "weight": weights})


def learned_weights(df: DataFrame, tiles: int, folds: int = 5, alpha: float = 0.1) -> DataFrame:
    """df(feature, p, base_mean) gets tile, fold and a weight learned on the other folds.

    Neighbouring tiles are held together by a penalty on the total variation of their thresholds, whose strength the other folds choose
    among themselves. What reaches the weight solver is a histogram of at most folds x tiles x 200 cells, whatever the number of
    tests. One tile means weight 1 throughout.
    """
    tiled = ntile(df, ["base_mean", "feature"], tiles).withColumn("fold", F.pmod(F.xxhash64("feature"), F.lit(folds)).cast("int"))
    if tiles == 1:
        return tiled.withColumn("weight", F.lit(1.0))
    step = (F.log10(F.greatest("p", F.lit(1e-8))) + 8.0) / 8.0 * (_CELLS - 1)
    cell = F.least(F.ceil(step), F.lit(_CELLS - 1)).cast("int")
    hist = (
        tiled.filter(F.col("p").isNotNull())
        .groupBy("fold", "tile", cell.alias("cell"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))).alias("outer"), F.col("fold").alias("inner"), "tile", "cell", "n")
        .withColumnRenamed("outer", "fold")
    )
    weights = hist.groupBy("fold").applyInPandas(lambda pdf: _learn(pdf, alpha), "fold int, tile int, weight double")
    out = tiled.join(weights, ["fold", "tile"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    # Within a fold the weights must average one over its own tests.
    scaled = with_group_stats(out, ["fold"], __mean=F.avg(F.when(F.col("p").isNotNull(), F.col("weight"))))
    return scaled.withColumn("weight", F.coalesce(F.try_divide(F.col("weight"), F.col("__mean")), F.lit(1.0))).drop("__mean")


def ihw(df: DataFrame, tiles: int, folds: int = 5, alpha: float = 0.05, out: str = "padj") -> DataFrame:
    """Covariate-weighted adjustment: learned weights, then the weighted step-up."""
    return weighted_bh(learned_weights(df, tiles, folds, alpha), "p", "weight", out)
