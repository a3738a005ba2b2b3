"""Components and distances beyond the size of a matrix in one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featuremill.operators import ordination as O


def table(spark, x):
    """features x samples as (feature, sample, x); zeros are left out."""
    wide = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "feature int, x array<double>")
    long = wide.select("feature", F.posexplode("x").alias("p", "x")).select("feature", F.format_string("s%05d", "p").alias("sample"), "x").filter("x <> 0")
    return long, spark.range(x.shape[1]).select(F.format_string("s%05d", "id").alias("sample"))


def exact(x, k, scale=False):
    c = x - x.mean(1, keepdims=True)
    if scale:
        sd = c.std(1, ddof=1, keepdims=True)
        c = np.divide(c, sd, out=np.zeros_like(c), where=sd > 0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    return (vt[:k] * s[:k, None]), s[:k] ** 2 / (s**2).sum()


@pytest.mark.parametrize("scale", [False, True])
def test_iteration_equals_the_matrix(spark, scale):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 70)) + 3 * np.outer(rng.normal(size=50), rng.normal(size=70))
    x[7] = 0.0
    long, samples = table(spark, x)
    want, share = exact(x, 4, scale)
    for cap in (4096, 10):
        got = O.pca_samples(long, samples, "x", 4, scale, max_side=cap).toPandas().pivot(index="component", columns="sample", values="score").to_numpy()
        assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)
        assert (got[np.arange(4), np.abs(got).argmax(1)] > 0).all()
        p = O.pca_samples(long, samples, "x", 4, scale, max_side=cap).groupBy("component").agg(F.max("proportion").alias("p")).orderBy("component").toPandas().p
        assert np.allclose(p, share)


def test_block_eigen_on_flat_and_small_spectra():
    rng = np.random.default_rng(1)
    for values in (np.linspace(1, 2, 200), np.r_[np.ones(5) * 7, np.ones(95)], np.r_[3.0, np.zeros(40)], np.ones(3)):
        q = np.linalg.qr(rng.normal(size=(len(values),) * 2))[0]
        m = (q * values) @ q.T
        got, v = O.block_eigen(lambda b: m @ b, len(values), 5)
        want = np.sort(values)[::-1][: len(got)]
        assert np.allclose(got, want, atol=1e-7) and np.allclose(v.T @ v, np.eye(len(got)), atol=1e-7)
    with pytest.raises(ValueError):
        O.block_eigen(lambda b: m * 0 @ b + np.linspace(1, 2, 3)[:, None] * b + rng.normal(size=b.shape), 3, 1, max_rounds=1)


@pytest.mark.parametrize("tile,side", [(16, 50), (7, 21), (64, 50)])
def test_tiles_equal_the_matrix(spark, tile, side):
    x = np.random.default_rng(side).normal(2, 1, (30, side)).round(3)
    long, samples = table(spark, x)
    whole = {(r.a, r.b): r.distance for r in O.pairwise_distance(long, samples, "x").collect()}
    tiled = {(r.a, r.b): r.distance for r in O.pairwise_distance(long, samples, "x", max_side=1, tile=tile).collect()}
    assert set(whole) == set(tiled) and len(whole) == side * (side - 1) // 2
    for (a, b), d in tiled.items():
        assert d == pytest.approx(whole[a, b]) == pytest.approx(float(np.linalg.norm(x[:, int(a[1:])] - x[:, int(b[1:])])))


def test_six_thousand_columns(spark):
    rng = np.random.default_rng(9)
    x = np.outer(rng.normal(size=40), rng.normal(size=6000)) * 2 + np.outer(rng.normal(size=40), rng.normal(size=6000)) + rng.normal(size=(40, 6000)) / 10
    long, samples = table(spark, x)
    want, share = exact(x, 2)
    out = O.pca_samples(long, samples, "x", 2).toPandas()
    got = out.pivot(index="component", columns="sample", values="score").to_numpy()
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-5) and np.allclose(out.groupby("component").proportion.max(), share)
