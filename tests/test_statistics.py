"""Order-dependent operators and tests against brute force, with a key that holds most rows."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featuremill.functions import tails
from featuremill.operators import inference as I
from featuremill.operators import multiple_testing as MT
from featuremill.operators import nbmodel as NB
from featuremill.operators import ordered as O
from featuremill.operators import ordination as D
from featuremill.operators.aggregate import describe


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": np.arange(3000), "k": rng.choice(["a", "b", "c"], 3000, p=[0.8, 0.15, 0.05]), "v": rng.integers(0, 400, 3000) / 8.0})
    return pdf, spark.createDataFrame(pdf).repartition(6)


def brute_bh(p):
    known = [x for x in p if x is not None]
    n = len(known)
    rank = {x: sum(y <= x for y in known) for x in known}
    return [None if x is None else min(1.0, min(y * n / rank[y] for y in known if y >= x)) for x in p]


def test_quantiles_and_mad(skewed):
    pdf, df = skewed
    got = O.quantiles_by(df, ["k"], "v", {"m": 0.5, "q": 0.93}).toPandas().set_index("k").sort_index()
    want = pdf.groupby("k").v.quantile([0.5, 0.93]).unstack()
    assert np.allclose(got[["m", "q"]].to_numpy(), want.to_numpy())
    mad = O.mad_by(df, ["k"], "v").toPandas().set_index("k").sort_index().mad
    want = pdf.groupby("k").v.apply(lambda s: (s - s.median()).abs().median() * 1.4826)
    assert np.allclose(mad.to_numpy(), want.to_numpy())


def test_rank_ntile_and_running_sum(skewed):
    pdf, df = skewed
    got = O.row_rank(df, ["v", "id"]).toPandas().sort_values("rank")
    assert got.id.tolist() == pdf.sort_values(["v", "id"]).id.tolist()
    assert got["rank"].tolist() == list(range(1, 3001))
    within = O.row_rank(df, ["v", "id"], keys=["k"]).toPandas()
    want = pdf.sort_values(["k", "v", "id"]).groupby("k").cumcount() + 1
    assert within.set_index("id")["rank"].sort_index().tolist() == want.reindex(pdf.id).tolist()
    tiles = O.ntile(df, ["v", "id"], 7).toPandas().tile.value_counts().sort_index().tolist()
    assert tiles == [429, 429, 429, 429, 428, 428, 428]
    sums = O.running_sum(df, ["k"], ["v", "id"], {"s": "v"}).toPandas().set_index("id").s.sort_index()
    want = pdf.sort_values(["k", "v", "id"]).groupby("k").v.cumsum().reindex(pdf.id)
    assert np.allclose(sums.to_numpy(), want.to_numpy())


def test_top_keeps_ties(skewed):
    pdf, df = skewed
    top, rest = O.top_and_rest(df, "v", 5)
    assert top.count() == len(pdf.v.nlargest(5, keep="all"))
    assert top.count() + rest.count() == 3000


def test_bh(spark):
    p = [0.01, 0.02, 0.02, None, 0.5, 1.0, 1.0, 0.04]
    got = MT.bh_adjust(spark.createDataFrame(list(enumerate(p)), "id int, p double")).orderBy("id").collect()
    for g, w in zip([x.padj for x in got], brute_bh(p)):
        assert (g is None and w is None) or g == pytest.approx(w)
    two = spark.createDataFrame([(k, i, x) for k in "ab" for i, x in enumerate(p)], "k string, id int, p double")
    keyed = MT.bh_adjust(two, keys=["k"]).filter("k = 'b'").orderBy("id").collect()
    assert [x.padj for x in keyed] == [x.padj for x in got]


def test_ihw_reduces_to_bh_with_one_tile(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"feature": np.arange(400), "p": rng.random(400) ** 2, "base_mean": rng.random(400)})
    df = spark.createDataFrame(pdf)
    one = MT.ihw(df, tiles=1).select("feature", "padj").toPandas().sort_values("feature").padj
    plain = MT.bh_adjust(df).toPandas().sort_values("feature").padj
    assert np.allclose(one, plain)
    learned = MT.learned_weights(df, tiles=4, folds=3).toPandas()
    assert len(learned) == 400 and (learned.weight >= 0).all()
    assert np.allclose(learned.groupby("fold").weight.mean(), 1.0)


def test_ihw_prefers_informative_tiles(spark):
    rng = np.random.default_rng(8)
    base = np.arange(2000.0)
    p = np.where(base >= 1000, rng.random(2000) ** 3, rng.random(2000))
    df = spark.createDataFrame(pd.DataFrame({"feature": np.arange(2000), "p": p, "base_mean": base}))
    w = MT.learned_weights(df, tiles=2, folds=2, alpha=0.05).toPandas().groupby("tile").weight.mean()
    assert w[2] > 1.5 > w[1]


def test_tails():
    for n, m, r, k in [(50, 10, 12, 4), (50, 10, 12, 0), (30, 5, 29, 5), (30, 29, 5, 5)]:
        want = sum(math.comb(m, i) * math.comb(n - m, r - i) for i in range(k, min(m, r) + 1)) / math.comb(n, r)
        assert tails.hypergeom_upper_np([n], [m], [r], [k])[0] == pytest.approx(want, rel=1e-10)
    x = np.array([0.3, 1.0, 2.5, 9.9, 150.0, 1e6])
    assert np.allclose(tails.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-13)
    # One degree of freedom is the Cauchy distribution, two have a closed form.
    assert tails.t_two_sided_np([1.0], [1.0])[0] == pytest.approx(0.5)
    assert tails.t_two_sided_np([2.0], [2.0])[0] == pytest.approx(1 - 2 / math.sqrt(6))
    ranks = [np.array([1, 2, 9]), np.array([], dtype=int), np.array([7])]
    got = tails.min_prefix_p_np(ranks, 10)
    want = min(tails.hypergeom_upper_np([10], [3], [r], [k])[0] for k, r in ((1, 1), (2, 2), (3, 9)))
    assert got[0] == pytest.approx(want) and got[1] == 1.0 and got[2] == pytest.approx(0.7)


def test_rank_sum(spark):
    a, b = [1.0, 2.0, 2.0, 5.0], [2.0, 3.0, 5.0, 5.0, 7.0]
    df = spark.createDataFrame([("x", v, "a") for v in a] + [("x", v, "b") for v in b] + [("y", 1.0, "a"), ("y", 1.0, "b")], "k string, v double, g string")
    out = {r.k: r for r in I.rank_sum_test(df, ["k"], "v", "g", "a", "b").collect()}
    u = sum((x > y) + 0.5 * (x == y) for x, y in itertools.product(a, b))
    assert out["x"].u == pytest.approx(u)
    n1, n2, n = 4, 5, 9
    ties = sum(t**3 - t for t in pd.Series(a + b).value_counts())
    sigma = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
    z = (u - 10 + 0.5) / sigma
    assert out["x"].z == pytest.approx(z) and out["x"].p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    assert out["y"].z is None


def test_welch_sparse_equals_dense(spark):
    rng = np.random.default_rng(2)
    samples = [(f"s{i}", "a" if i < 4 else "b") for i in range(9)]
    dense = [("f", s, g, float(rng.integers(0, 3))) for s, g in samples]
    full = spark.createDataFrame(dense, "k string, sample string, g string, v double")
    sizes = spark.createDataFrame([("a", 4), ("b", 5)], "g string, n long")
    d = I.welch_stats(full, ["k"], "v", "g", "a", "b").first()
    s = I.welch_stats_sparse(full.filter("v > 0"), ["k"], "v", "g", "a", "b", sizes).first()
    for c in ("t", "dof", "effect", "mean1", "mean2"):
        assert d[c] == pytest.approx(s[c])


def test_welch_sparse_keeps_digits_of_large_values(spark):
    """Values near 10^9 that differ by a little, without an absent cell and with one."""
    a, b = [1e9 + x for x in (0.0, 1.0, 2.0, 4.0)], [1e9 + x for x in (1.0, 2.0, 5.0, 6.0, 7.0)]
    rows = [("k", "a", v) for v in a] + [("k", "b", v) for v in b]
    df = spark.createDataFrame(rows, "k string, g string, v double")
    got = I.welch_stats_sparse(df, ["k"], "v", "g", "a", "b", spark.createDataFrame([("a", 4), ("b", 5)], "g string, n long")).first()
    e = np.var(np.array(a) - 1e9, ddof=1) / 4 + np.var(np.array(b) - 1e9, ddof=1) / 5
    assert got.t == pytest.approx((np.mean(np.array(b) - 1e9) - np.mean(np.array(a) - 1e9)) / math.sqrt(e), rel=1e-6)
    more = I.welch_stats_sparse(df, ["k"], "v", "g", "a", "b", spark.createDataFrame([("a", 5), ("b", 5)], "g string, n long")).first()
    assert more.mean1 == pytest.approx(np.mean([*a, 0.0])) and more.n1 == 5


def test_linear_fit_and_describe(spark):
    pts = [(1.0, 2.1), (2.0, 3.9), (3.0, 6.2), (4.0, 7.8)]
    df = spark.createDataFrame(pts, "x double, y double")
    fit = I.linear_fit(df, "y", "x").first()
    slope, icept = np.polyfit(*np.array(pts).T, 1)
    assert fit.slope == pytest.approx(slope) and fit.intercept == pytest.approx(icept)
    assert I.fitted_line(df, "y", "x").agg(F.sum("residual")).first()[0] == pytest.approx(0, abs=1e-9)
    d = {r.variable: r for r in describe(df, ["x", "y"]).collect()}
    assert d["x"]["median"] == 2.5 and d["y"]["max"] == 7.8


def _nb(rng, mean, alpha, size):
    return rng.poisson(rng.gamma(1 / alpha, alpha * mean, size))


def test_nb_kernels_recover_parameters():
    rng = np.random.default_rng(1)
    g = np.repeat([0, 1], 30)
    s = rng.uniform(0.6, 1.6, 60)
    k = _nb(rng, np.where(g == 1, 400.0, 100.0) * s, 0.2, (60, 60)).astype(float)
    alpha = NB.genewise_dispersion_np(k, s, g)
    assert np.median(alpha) == pytest.approx(0.2, rel=0.15)
    lfc, se, mu, settled = NB.wald_np(k, s, g, np.full(60, 0.2))
    assert settled.all() and np.allclose(mu[:, g == 0] / s[g == 0], (mu[:, g == 0] / s[g == 0])[:, :1])
    assert lfc.mean() == pytest.approx(2.0, abs=0.1) and lfc.std() == pytest.approx(se.mean(), rel=0.4)
    shrunk = NB.map_dispersion_np(k, s, g, np.full(60, 0.2), 0.01)
    assert np.abs(np.log(shrunk / 0.2)).max() < np.abs(np.log(alpha / 0.2)).max()
    raw = np.log2(np.maximum(k / s, 0.5))
    assert NB.rlog_np(k, s, np.full(60, 0.2), 0.25).std() < raw.std()


def test_wald_test_on_spark(spark):
    rng = np.random.default_rng(4)
    samples = spark.createDataFrame([(f"s{i}", "ctl" if i < 6 else "trt") for i in range(12)], "sample string, condition string")
    factors = samples.select("sample", F.lit(1.0).alias("size_factor"))
    data = []
    for f in range(80):
        mean = np.where(np.arange(12) >= 6, 50.0 * (8 if f < 8 else 1), 50.0)
        data += [(f, f"s{i}", float(c)) for i, c in enumerate(_nb(rng, mean, 0.1, 12)) if c > 0]
    data.append((999, "s0", 0.0))
    counts = spark.createDataFrame(data, "feature long, sample string, count double")
    out = MT.bh_adjust(NB.wald_test(NB.model_input(counts, samples, factors, "trt"))).toPandas().set_index("feature")
    assert np.isnan(out.loc[999, "p"]) and len(out) == 81
    assert (out.loc[range(8), "padj"] < 0.01).all() and out.loc[range(8), "log2fc"].mean() == pytest.approx(3.0, abs=0.4)
    assert (out.loc[range(8, 80), "padj"] < 0.05).sum() <= 6
    values = NB.rlog(NB.model_input(counts, samples, factors, "trt"), samples)
    assert values.count() == 80 * 12


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6, 40))
    long = spark.createDataFrame([(f, f"s{i}", float(x[i, f])) for i in range(6) for f in range(40)], "feature int, sample string, x double")
    samples = spark.createDataFrame([(f"s{i}",) for i in range(6)], "sample string")
    out = D.pca_samples(long, samples, "x", k=3)
    c = x - x.mean(axis=0)
    u, sv, _ = np.linalg.svd(c, full_matrices=False)
    got = out.toPandas().pivot(index="sample", columns="component", values="score").to_numpy()
    assert np.allclose(np.abs(got), np.abs((u * sv)[:, :3]))
    ev = D.explained_variance(out).orderBy("component").toPandas()
    assert np.allclose(ev.proportion, (sv**2 / (sv**2).sum())[:3])
    dist = D.pairwise_distance(long, samples, "x").toPandas()
    assert len(dist) == 15 and dist.distance.iloc[0] > 0
    for _, r in dist.iterrows():
        assert r.distance == pytest.approx(np.linalg.norm(x[int(r.a[1])] - x[int(r.b[1])]))
    assert D.knn_graph(D.pairwise_distance(long, samples, "x"), 2).count() == 12


def test_pca_points_matches_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(50, 5)) * [5, 3, 2, 1, 0.5]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, e array<double>")
    got = np.array([r.scores for r in D.pca_points(df, "id", "e", 2).orderBy("id").collect()])
    c = x - x.mean(axis=0)
    u, sv, _ = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs((u * sv)[:, :2]))
