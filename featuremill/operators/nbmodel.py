"""Negative-binomial model per feature: dispersion, two-group Wald test, regularised log.

Spark partitions the features; the numpy kernels below see one Arrow batch of feature vectors at a
time. The dispersion trend and the prior width are fitted from Spark aggregates.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tails import log_gamma, normal_two_sided
from ..session import cut_lineage
from .ordered import mad_by, quantiles_by
from .vectors import feature_vectors, with_design

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_DISPERSION = 1e-8
MIN_MU = 0.5
NEWTON_STEPS = 200

# Fixed values of the outlier rule: samples of a group it takes, for groups up to that size the share trimmed at either end and the factor that
# makes the trimmed squares a variance, the smallest robust dispersion, the coefficients of the model, the quantile, and larger counts that excuse a cell.
MIN_REPLICATES = 3
TRIMS = ((3, 1 / 3, 2.04), (23, 1 / 4, 1.86), (math.inf, 1 / 8, 1.51))
MIN_ROBUST, COEFFICIENTS, COOKS_QUANTILE, LARGER_COUNTS = 0.04, 2, 0.99, 3


def model_input(counts: DataFrame, samples: DataFrame, factors: DataFrame, treated: str) -> DataFrame:
    """(feature, k, s, g): counts, size factors and group index in one sample order."""
    design = samples.select("sample", "condition").distinct().join(factors, "sample").select(
        "sample", F.col("size_factor").alias("s"), (F.col("condition") == treated).cast("int").alias("g")
    )
    return with_design(feature_vectors(counts, design, "count"), design, ["s", "g"])


def _arrays(pdf: pd.DataFrame):
    k = np.stack(pdf["k"].to_numpy()).astype(float)
    s = np.asarray(pdf["s"].iloc[0], dtype=float)
    g = np.asarray(pdf["g"].iloc[0], dtype=int)
    return k, s, g


def _group_mu(k, s, g):
    q = k / s
    mu = np.empty_like(k)
    for level in np.unique(g):
        mu[:, g == level] = q[:, g == level].mean(axis=1, keepdims=True)
    return np.maximum(mu * s, MIN_MU)


def _profile(log_alpha, k, mu, g):
    """Cox-Reid adjusted profile log likelihood at one log dispersion per feature."""
    alpha = np.exp(log_alpha)[:, None]
    r = 1.0 / alpha
    ll = (
        log_gamma(k + r) - log_gamma(r) - r * np.log1p(alpha * mu) + k * (np.log(alpha * mu) - np.log1p(alpha * mu))
    ).sum(axis=1)
    w = mu / (1.0 + alpha * mu)
    for level in np.unique(g):
        ll = ll - 0.5 * np.log(w[:, g == level].sum(axis=1))
    return ll


def _maximise(score, n: int, low: float, high: float, grid: int = 24, rounds: int = 32) -> np.ndarray:
    """Vectorised one-dimensional maximum: grid, then golden-section around the best grid point."""
    points = np.linspace(low, high, grid)
    table = np.stack([score(np.full(n, p)) for p in points])
    best = table.argmax(axis=0)
    a = points[np.maximum(best - 1, 0)]
    b = points[np.minimum(best + 1, grid - 1)]
    ratio = (math.sqrt(5.0) - 1.0) / 2.0
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = score(c), score(d)
    for _ in range(rounds):
        left = fc > fd
        a, b = np.where(left, a, c), np.where(left, d, b)
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        fc, fd = score(c), score(d)
    return (a + b) / 2.0


def _log_bounds(n_samples: int) -> tuple[float, float]:
    return math.log(MIN_DISPERSION), math.log(max(10.0, float(n_samples)))


def genewise_dispersion_np(k, s, g) -> np.ndarray:
    mu = _group_mu(k, s, g)
    low, high = _log_bounds(k.shape[1])
    return np.exp(_maximise(lambda la: _profile(la, k, mu, g), len(k), low, high))


def map_dispersion_np(k, s, g, trend, prior_var) -> np.ndarray:
    mu = _group_mu(k, s, g)
    low, high = _log_bounds(k.shape[1])
    centre = np.log(trend)
    return np.exp(
        _maximise(lambda la: _profile(la, k, mu, g) - (la - centre) ** 2 / (2.0 * prior_var), len(k), low, high)
    )


def wald_np(k, s, g, alpha):
    """Group log means by Newton steps with a weak ridge: (log2 fold change, its standard error, fitted means, whether both groups settled)."""
    ridge = 1e-6
    beta, info, fitted, settled = {}, {}, np.empty_like(k), np.ones(len(k), bool)
    for level in (0, 1):
        kk, ss = k[:, g == level], s[g == level]
        b = np.log(np.maximum((kk / ss).mean(axis=1), 0.1))
        for _ in range(NEWTON_STEPS):
            mu = ss * np.exp(b)[:, None]
            denom = 1.0 + alpha[:, None] * mu
            grad = ((kk - mu) / denom).sum(axis=1) - ridge * b
            hess = (mu * (1.0 + alpha[:, None] * kk) / denom**2).sum(axis=1) + ridge
            step = np.clip(grad / hess, -2.0, 2.0)
            b = b + step
            if np.all(np.abs(step) < 1e-10):
                break
        settled &= np.abs(step) < 1e-6
        mu = ss * np.exp(b)[:, None]
        fitted[:, g == level] = mu
        beta[level], info[level] = b, (mu / (1.0 + alpha[:, None] * mu)).sum(axis=1) + ridge
    ln2 = math.log(2.0)
    return (beta[1] - beta[0]) / ln2, np.sqrt(1.0 / info[0] + 1.0 / info[1]) / ln2, fitted, settled


# Outliers -------------------------------------------------------------------------------------


def _trimmed_mean(x: np.ndarray, share: float) -> np.ndarray:
    cut = int(x.shape[1] * share)
    return np.sort(x, axis=1)[:, cut : x.shape[1] - cut].mean(axis=1)


def _trimmed_variance(q: np.ndarray, share: float, factor: float) -> np.ndarray:
    squares = (q - _trimmed_mean(q, share)[:, None]) ** 2
    return factor * _trimmed_mean(squares, share)


def robust_dispersion_np(k, s, g) -> np.ndarray:
    """Dispersion by moments from trimmed variances, so that one wild cell does not hide itself.

    The largest variance of the groups with MIN_REPLICATES samples counts; without such a group, that of all samples.
    """
    q = k / s
    spread = []
    for level in np.unique(g):
        x = q[:, g == level]
        if x.shape[1] >= MIN_REPLICATES:
            _, share, factor = next(t for t in TRIMS if x.shape[1] <= t[0])
            spread.append(_trimmed_variance(x, share, factor))
    variance = np.max(spread, axis=0) if spread else _trimmed_variance(q, *TRIMS[-1][1:])
    mean = q.mean(axis=1)
    return np.maximum((variance - mean) / np.maximum(mean, 1e-300) ** 2, MIN_ROBUST)


def cooks_np(k, s, g, alpha, mu) -> np.ndarray:
    """Cook's distance of every cell: how far the fit would move without it.

    The squared residual over its robust variance, times leverage; a cell's leverage is its share of its group's weight.
    """
    w = mu / (1.0 + alpha[:, None] * mu)
    leverage = np.empty_like(w)
    for level in np.unique(g):
        here = w[:, g == level]
        leverage[:, g == level] = here / here.sum(axis=1, keepdims=True)
    residual = (k - mu) ** 2 / (mu + robust_dispersion_np(k, s, g)[:, None] * mu**2)
    with np.errstate(divide="ignore", invalid="ignore"):
        d = residual / COEFFICIENTS * leverage / (1.0 - leverage) ** 2
    return np.where(leverage < 1.0, d, 0.0)


def cooks_cutoff(n_samples: int) -> float:
    """Quantile of the F distribution with two and n - 2 degrees of freedom, which has a closed form."""
    rest = n_samples - COEFFICIENTS
    if rest <= 0:
        return math.inf
    return rest / 2.0 * ((1.0 - COOKS_QUANTILE) ** (-2.0 / rest) - 1.0)


def count_outliers_np(k, s, g, alpha, mu) -> tuple[np.ndarray, np.ndarray]:
    """(largest distance over samples of groups with MIN_REPLICATES, whether it marks a count outlier) for each feature.

    A cell is excused when LARGER_COUNTS other cells of the feature have larger counts. Without such a group nothing is marked.
    """
    usable = np.isin(g, [v for v in np.unique(g) if (g == v).sum() >= MIN_REPLICATES])
    if not usable.any():
        return np.full(len(k), np.nan), np.zeros(len(k), bool)
    d = np.where(usable[None, :], cooks_np(k, s, g, alpha, mu), -1.0)
    at = d.argmax(axis=1)
    top = d[np.arange(len(k)), at]
    larger = (k > k[np.arange(len(k)), at][:, None]).sum(axis=1)
    return top, (top > cooks_cutoff(k.shape[1])) & (larger < LARGER_COUNTS)


def rlog_np(k, s, alpha, prior_var) -> np.ndarray:
    """log2 of shrunken per-sample means: a ridge on each sample's log deviation from the feature mean."""
    centre = np.log(np.maximum((k / s).mean(axis=1), 1e-8))[:, None]
    a = alpha[:, None]
    b = np.zeros_like(k)
    for _ in range(NEWTON_STEPS):
        mu = s * np.exp(centre + b)
        denom = 1.0 + a * mu
        grad = (k - mu) / denom - b / prior_var
        hess = mu * (1.0 + a * k) / denom**2 + 1.0 / prior_var
        step = np.clip(grad / hess, -2.0, 2.0)
        b = b + step
        if np.all(np.abs(step) < 1e-10):
            break
    else:
        if not np.all(np.abs(step) < 1e-6):
            raise ValueError(f"shrunken values do not settle in {NEWTON_STEPS} steps")
    return (centre + b) / math.log(2.0)


def _add(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in fields]])


def _genewise_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            yield pdf.assign(disp_gene=genewise_dispersion_np(*_arrays(pdf)))


def genewise_dispersion(model: DataFrame) -> DataFrame:
    """Maximum of the adjusted profile likelihood per feature; all-zero features are left out."""
    total = F.aggregate("k", F.lit(0.0), lambda a, x: a + x)
    mean = F.aggregate(F.zip_with("k", "s", lambda k, s: k / s), F.lit(0.0), lambda a, x: a + x) / F.size("k")
    live = model.filter(total > 0).withColumn("base_mean", mean)
    return live.mapInPandas(_genewise_batches, _add(live.schema, ("disp_gene", T.DoubleType())))


class Trend(NamedTuple):
    """Dispersion = a1 / mean + a0, and the rounds that the fit took."""

    a1: float
    a0: float
    rounds: int


def fit_trend(genewise: DataFrame, max_rounds: int = 200, tolerance: float = 1e-6) -> Trend:
    """Coefficients of dispersion = a1 / mean + a0, refitted until they settle; fails when they do not in ``max_rounds``.

    A gamma fit with identity link by reweighted least squares, neither coefficient below zero. Each round takes the features whose dispersion is within wide bounds of the
    last trend (1e-4 and 15 times), so the features that count are chosen anew until neither they nor the coefficients change. A round is one
    aggregate over the stored gene-wise table; five sums reach the driver.
    """
    usable = genewise.filter(F.col("disp_gene") >= 100 * MIN_DISPERSION).select(
        (1.0 / F.col("base_mean")).alias("x"), F.col("disp_gene").alias("y")
    )
    usable = cut_lineage(usable)
    a1, a0 = 0.1, 1.0
    for n in range(1, max_rounds + 1):
        fit = F.lit(a1) * F.col("x") + F.lit(a0)
        near = usable.filter((F.col("y") / fit > 1e-4) & (F.col("y") / fit < 15.0))
        w = 1.0 / (fit * fit)
        r = near.agg(
            F.sum(w).alias("w"), F.sum(w * F.col("x")).alias("wx"), F.sum(w * F.col("x") * F.col("x")).alias("wxx"),
            F.sum(w * F.col("y")).alias("wy"), F.sum(w * F.col("x") * F.col("y")).alias("wxy"),
        ).first()
        if r["w"] is None:
            return Trend(0.0, 0.1, n)
        det = r["w"] * r["wxx"] - r["wx"] ** 2
        if det <= 1e-12 * r["w"] * r["wxx"]:
            return Trend(0.0, max(r["wy"] / r["w"], MIN_DISPERSION), n)
        n1, n0 = (r["w"] * r["wxy"] - r["wx"] * r["wy"]) / det, (r["wxx"] * r["wy"] - r["wx"] * r["wxy"]) / det
        if n1 <= 0:  # the best line without a negative part has only the other one
            n1, n0 = MIN_DISPERSION, r["wy"] / r["w"]
        elif n0 <= 0:
            n1, n0 = r["wxy"] / r["wxx"], MIN_DISPERSION
        moved = math.log(n1 / a1) ** 2 + math.log(n0 / a0) ** 2
        a1, a0 = n1, n0
        if moved < tolerance:
            return Trend(a1, a0, n)
    raise ValueError(f"the dispersion trend does not settle in {max_rounds} rounds")


def _trigamma(x: float) -> float:
    total = 0.0
    while x < 10.0:
        total += 1.0 / (x * x)
        x += 1.0
    return total + 1.0 / x + 1.0 / (2 * x * x) + 1.0 / (6 * x**3) - 1.0 / (30 * x**5) + 1.0 / (42 * x**7)


def dispersion(model: DataFrame) -> DataFrame:
    """Gene-wise, trend and final dispersion; features far above the trend (``disp_outlier``) keep their own value."""
    genewise = cut_lineage(genewise_dispersion(model))
    a1, a0, _ = fit_trend(genewise)
    trended = genewise.withColumn("disp_trend", F.lit(a1) / F.col("base_mean") + F.lit(a0))
    resid = trended.filter(F.col("disp_gene") >= 100 * MIN_DISPERSION).select(
        F.log(F.col("disp_gene") / F.col("disp_trend")).alias("r")
    )
    spread = mad_by(resid, [], "r").first()["mad"] or 0.0
    # The design is two groups over a fixed sample list, so one row states its degrees of freedom.
    first = genewise.select(F.size("k").alias("m")).first()
    m = first["m"] if first else 3
    prior_var = max(spread**2 - _trigamma(max(m - 2, 1) / 2.0), 0.25)

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                trend = pdf["disp_trend"].to_numpy(dtype=float)
                final = map_dispersion_np(*_arrays(pdf), trend, prior_var)
                own = pdf["disp_gene"].to_numpy(dtype=float)
                outlier = (np.log(own) > np.log(trend) + 2.0 * spread) & (spread > 0)
                yield pdf.assign(disp=np.where(outlier, own, final), disp_outlier=outlier)

    return trended.mapInPandas(shrink, _add(trended.schema, ("disp", T.DoubleType()), ("disp_outlier", T.BooleanType())))


def _wald_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            (k, s, g), alpha = _arrays(pdf), pdf["disp"].to_numpy(dtype=float)
            lfc, se, mu, settled = wald_np(k, s, g, alpha)
            cooks, outlier = count_outliers_np(k, s, g, alpha, mu)
            yield pd.DataFrame({
                "feature": pdf["feature"], "base_mean": pdf["base_mean"], "dispersion": pdf["disp"], "log2fc": lfc, "se": se, "settled": settled,
                "max_cooks": cooks, "count_outlier": outlier,
            })


def wald_test(model: DataFrame, outliers: bool = True) -> DataFrame:
    """(feature, base_mean, dispersion, log2fc, se, settled, max_cooks, count_outlier, z, p); all-zero features come back with missing results.

    A feature with a count outlier (see :func:`count_outliers_np`) gets a missing p, so that one wild sample does not make it significant and
    later adjustments do not count it; ``outliers=False`` keeps its p.
    """
    fitted = dispersion(model)
    fields = [("base_mean", T.DoubleType()), ("dispersion", T.DoubleType()), ("log2fc", T.DoubleType()), ("se", T.DoubleType()), ("settled", T.BooleanType())]
    fields += [("max_cooks", T.DoubleType()), ("count_outlier", T.BooleanType())]
    schema = T.StructType([model.schema["feature"], *[T.StructField(n, t) for n, t in fields]])
    tests = fitted.mapInPandas(_wald_batches, schema).withColumn("z", F.col("log2fc") / F.col("se"))
    tests = tests.withColumn("p", normal_two_sided("z"))
    if outliers:
        tests = tests.withColumn("p", F.when(~F.col("count_outlier"), F.col("p")))
    return model.select("feature").join(tests, "feature", "left").withColumn(
        "base_mean", F.coalesce("base_mean", F.lit(0.0))
    )


def rlog(model: DataFrame, samples: DataFrame) -> DataFrame:
    """Regularised log2 values (feature, sample, rlog), blind to the groups."""
    from .vectors import sample_order

    blind = model.withColumn("g", F.transform("g", lambda x: F.lit(0)))
    genewise = cut_lineage(genewise_dispersion(blind))
    a1, a0, _ = fit_trend(genewise)
    trended = genewise.withColumn("disp", F.lit(a1) / F.col("base_mean") + F.lit(a0))
    ratios = trended.select(
        F.explode(F.zip_with("k", "s", lambda k, s: k / s)).alias("q"), "base_mean"
    ).select(F.abs(F.log((F.col("q") + 0.5) / (F.col("base_mean") + 0.5))).alias("d"))
    width = quantiles_by(ratios, [], "d", {"q": 0.95}).first()["q"] or 1.0
    prior_var = max((width / 1.96) ** 2, 1e-4)

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                k, s, _g = _arrays(pdf)
                values = rlog_np(k, s, pdf["disp"].to_numpy(dtype=float), prior_var)
                yield pd.DataFrame({"feature": pdf["feature"], "values": list(values)})

    schema = T.StructType([model.schema["feature"], T.StructField("values", T.ArrayType(T.DoubleType()))])
    out = trended.mapInPandas(shrink, schema)
    return out.select("feature", F.arrays_zip(sample_order(samples).alias("sample"), F.col("values").alias("rlog")).alias("z")).select(
        "feature", F.inline("z")
    )
