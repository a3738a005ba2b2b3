"""Count outliers and the dispersion trend against plain Python."""

import math

import numpy as np
import pytest

from featuremill.operators import multiple_testing as MT
from featuremill.operators import nbmodel as NB


def table(rng, features=60, per_group=5, alpha=0.05):
    n = 2 * per_group
    s = rng.uniform(0.7, 1.4, n)
    g = np.repeat([0, 1], per_group)
    k = rng.poisson(rng.gamma(1 / alpha, alpha * 80.0 * s, (features, n))).astype(float)
    return k, s, g


def trimmed(x, share):
    x = sorted(x)
    cut = int(len(x) * share)
    x = x[cut : len(x) - cut]
    return sum(x) / len(x)


def plain_cooks(k, s, g, alpha, mu):
    """One feature, cell by cell."""
    q = [a / b for a, b in zip(k, s)]
    variances = []
    for level in set(g):
        x = [v for v, h in zip(q, g) if h == level]
        if len(x) >= 3:
            share, factor = (1 / 3, 2.04) if len(x) <= 3 else (1 / 4, 1.86) if len(x) <= 23 else (1 / 8, 1.51)
            centre = trimmed(x, share)
            variances.append(factor * trimmed([(v - centre) ** 2 for v in x], share))
    mean = sum(q) / len(q)
    robust = max((max(variances) - mean) / mean**2, 0.04)
    w = [m / (1 + alpha * m) for m in mu]
    out = []
    for i in range(len(k)):
        h = w[i] / sum(w[j] for j in range(len(k)) if g[j] == g[i])
        out.append((k[i] - mu[i]) ** 2 / (mu[i] + robust * mu[i] ** 2) / 2 * h / (1 - h) ** 2)
    return out


@pytest.mark.parametrize("per_group", [3, 5, 24])
def test_distances_cell_by_cell(per_group):
    k, s, g = table(np.random.default_rng(per_group), 12, per_group)
    k[3, 0] = 9000
    alpha = np.full(12, 0.07)
    _, _, mu, _ = NB.wald_np(k, s, g, alpha)
    got = NB.cooks_np(k, s, g, alpha, mu)
    for f in range(12):
        assert got[f] == pytest.approx(plain_cooks(k[f], s, g, 0.07, mu[f]))


def test_cutoff_is_the_quantile():
    for n in (6, 10, 48):
        x, rest = NB.cooks_cutoff(n), n - 2
        # Distribution function of F with 2 and rest degrees of freedom.
        assert 1 - (1 + 2 * x / rest) ** (-rest / 2) == pytest.approx(0.99)
    assert NB.cooks_cutoff(2) == math.inf


def test_marks_and_excuses():
    k, s, g = table(np.random.default_rng(0), 40, 5)
    s[:] = 1.0
    k[1, 2] = 20000  # a wild cell
    k[2] = [0, 0, 0, 0, 900, 5000, 5200, 4800, 5100, 5000]  # far from its group, but below five others
    alpha = np.full(40, 0.05)
    mu = NB.wald_np(k, s, g, alpha)[2]
    top, marked = NB.count_outliers_np(k, s, g, alpha, mu)
    assert marked[1] and not marked[2] and top[2] > NB.cooks_cutoff(10) and marked.sum() <= 3
    assert not NB.count_outliers_np(k[:, [0, 1, 5, 6]], s[:4], g[[0, 1, 5, 6]], alpha, mu[:, [0, 1, 5, 6]])[1].any()


def on_spark(spark, k, s, g):
    n = k.shape[1]
    samples = spark.createDataFrame([(f"s{i:02d}", "trt" if g[i] else "ctl") for i in range(n)], "sample string, condition string")
    factors = spark.createDataFrame([(f"s{i:02d}", float(s[i])) for i in range(n)], "sample string, size_factor double")
    counts = spark.createDataFrame([(f, f"s{i:02d}", float(k[f, i])) for f in range(len(k)) for i in range(n)], "feature long, sample string, count double")
    return NB.model_input(counts, samples, factors, "trt")


def test_a_wild_cell_makes_p_missing(spark):
    k, s, g = table(np.random.default_rng(2), 60, 5)
    plain = {r.feature: r for r in NB.wald_test(on_spark(spark, k, s, g)).collect()}
    wild = k.copy()
    wild[7, 3] = 30000
    model = on_spark(spark, wild, s, g)
    got = {r.feature: r for r in NB.wald_test(model).collect()}
    assert got[7].p is None and got[7].count_outlier and got[7].log2fc is not None
    assert NB.wald_test(model, outliers=False).filter("feature = 7").first().p is not None
    for f in set(range(60)) - {7}:
        assert got[f].count_outlier == plain[f].count_outlier and (got[f].p is None) == (plain[f].p is None)
        assert got[f].log2fc == pytest.approx(plain[f].log2fc, abs=0.02)  # only the shared trend moves, and with it the widths
    tested = MT.independent_filter(NB.wald_test(model), steps=5).collect()
    known = sorted((r.p, r.feature) for r in tested if r.p is not None and r.padj is not None)
    best = {f: min(1.0, min(p * len(known) / (i + 1) for i, (p, _) in enumerate(known) if i >= j)) for j, (_, f) in enumerate(known)}
    assert 7 not in best
    for r in tested:
        if r.feature in best:
            assert r.padj == pytest.approx(best[r.feature])


def plain_trend(x, y, rounds=10_000):
    a1, a0 = 0.1, 1.0
    for n in range(rounds):
        fit = a1 * x + a0
        use = (y / fit > 1e-4) & (y / fit < 15)
        w = 1 / fit[use] ** 2
        m = np.stack([x[use], np.ones(use.sum())])
        b1, b0 = np.linalg.solve((m * w) @ m.T, (m * w) @ y[use])
        if b1 <= 0:
            b1, b0 = 1e-8, np.average(y[use], weights=w)
        elif b0 <= 0:
            b1, b0 = (w * x[use] * y[use]).sum() / (w * x[use] ** 2).sum(), 1e-8
        moved = math.log(b1 / a1) ** 2 + math.log(b0 / a0) ** 2
        a1, a0 = b1, b0
        if moved < 1e-6:
            return a1, a0, n + 1
    raise AssertionError


def slow_trend():
    """Dispersions on steps just inside the bounds of one another, so that every round takes in a few more features."""
    x = 1 / np.geomspace(1, 1e5, 400)
    y = 3e-4 + 40 * x**1.9
    return x, y


def test_trend_goes_on_until_it_settles(spark):
    x, y = slow_trend()
    want = plain_trend(x, y)
    assert want[2] > 12
    df = spark.createDataFrame([(float(1 / a), float(b)) for a, b in zip(x, y)], "base_mean double, disp_gene double")
    got = NB.fit_trend(df)
    assert got.rounds == want[2] and got.a1 == pytest.approx(want[0]) and got.a0 == pytest.approx(want[1])
    with pytest.raises(ValueError):
        NB.fit_trend(df, max_rounds=12)


def test_wide_dispersions_are_reported(spark):
    k, s, g = table(np.random.default_rng(5), 80, 6)
    k[4] = [0, 900, 3, 700, 1, 40, 2, 800, 0, 5, 600, 1]
    rows = {r.feature: r for r in NB.dispersion(on_spark(spark, k, s, g)).collect()}
    assert rows[4].disp_outlier and rows[4].disp == pytest.approx(rows[4].disp_gene)
    assert sum(r.disp_outlier for r in rows.values()) < 12
    assert all(math.log(r.disp_gene) <= math.log(r.disp_trend) + 5 for r in rows.values() if not r.disp_outlier)
