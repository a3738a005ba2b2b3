"""Exact neighbours in blocks against all distances."""

import numpy as np
import pytest

from featuremill.operators import ordination as O


@pytest.mark.parametrize("n,block", [(150, 16), (40, 1024), (5, 9), (0, 9)])
def test_nearest_in_blocks(spark, n, block):
    rng = np.random.default_rng(n)
    x = rng.normal(0, 1, (n, 3)) * [5, 1, 1]
    if n > 20:
        x[3] = x[4] = x[5]
    df = spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in O.nearest(df, 4, block).collect():
        got.setdefault(r.id, []).append((r.nth, r.neighbour, r.distance))
    assert len(got) == (n if n > 1 else 0)
    for i in range(n):
        want = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), j) for j in range(n) if j != i)[:4]
        assert [(j, pytest.approx(d)) for d, j in want] == [(j, d) for _, j, d in sorted(got[i])]


@pytest.mark.parametrize("dims,spread,most", [(5, 40.0, 0.35), (64, 1.0, 1.0)])
def test_pivots_rule_blocks_out(spark, dims, spread, most):
    """Whole vectors and few scores, in clusters and without: exact, and the share of block pairs that are compared."""
    rng = np.random.default_rng(dims)
    x = rng.normal(0, spread, (12, dims))[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, dims))
    x[10:14] = x[3]
    df = spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(x)], "id long, v array<double>")
    rows, _, pairs = O._index(df, 8, 64)
    blocks = rows.select("block").distinct().count()
    share = pairs.count() / (blocks * (blocks - 1))
    print(f"{dims} dimensions: {share:.2f} of block pairs compared")
    assert share <= most
    got = {}
    for r in O.nearest(df, 8, 64).collect():
        got.setdefault(r.id, []).append((r.nth, r.neighbour, r.distance))
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for i in range(1500):
        want = np.argsort(d[i], kind="stable")[:8]
        assert [j for _, j, _ in sorted(got[i])] == want.tolist()


def test_components_of_samples(spark):
    rows = [(f"f{f}", f"s{s}", float((f * 7 + s * s) % 11)) for f in range(30) for s in range(12)]
    long = spark.createDataFrame(rows, "feature string, sample string, x double")
    samples = spark.createDataFrame([(f"s{s}", "a") for s in range(12)], "sample string, condition string")
    scores = {}
    for r in O.pca_samples(long, samples, "x", 5).collect():
        scores.setdefault(r.sample, {})[r.component] = r.score
    v = {s: np.array([c[i] for i in sorted(c)]) for s, c in scores.items()}
    got = {}
    for r in O.knn_on_components(long, samples, "x", 3, 5).collect():
        got.setdefault(r.sample, []).append((r.nth, r.distance))
    for s in v:
        want = sorted(np.linalg.norm(v[s] - v[t]) for t in v if t != s)[:3]
        assert [d for _, d in sorted(got[s])] == pytest.approx(want, abs=1e-6)


def test_pivots_are_the_same_from_few_rows(spark, monkeypatch):
    """The bound on the hash leaves out only rows that the sample would not have."""
    rng = np.random.default_rng(8)
    points = spark.createDataFrame([(i, [float(a) for a in rng.normal(size=3)]) for i in range(3000)], "id long, v array<double>")
    monkeypatch.setattr(O, "PIVOT_SAMPLE", 200)
    assert np.array_equal(O.choose_pivots(points, 6, 3000), O.choose_pivots(points, 6, 0))


@pytest.mark.parametrize("group", [1, 3, 100])
def test_nearest_by_groups_of_blocks(spark, monkeypatch, group):
    """Many equal vectors, and blocks compared group by group; a group gives k rows for each point."""
    monkeypatch.setattr(O, "GROUP", group)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (200, 2)).astype(float)
    df = spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(x)], "id long, v array<double>")
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    got = {}
    for r in O.nearest(df, 5, 16).collect():
        got.setdefault(r.id, []).append((r.nth, r.neighbour, r.distance))
    for i in range(200):
        want = np.argsort(d[i], kind="stable")[:5]
        assert [j for _, j, _ in sorted(got[i])] == want.tolist() and [z for _, _, z in sorted(got[i])] == pytest.approx(d[i][want])
