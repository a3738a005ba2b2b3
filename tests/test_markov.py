"""Clustering rounds against dense numpy, with hubs and shares small enough to be dealt."""

import numpy as np
import pytest

from featuremill.operators import graph as G
from featuremill.session import cut_lineage, release


def graph(n=30, seed=4):
    rng = np.random.default_rng(seed)
    edges = {(0, i) for i in range(1, n)} | {tuple(sorted(rng.choice(n, 2, False).tolist())) for _ in range(60)}
    return sorted((int(a), int(b)) for a, b in edges)


def dense_round(m, inflation, prune):
    s = (m @ m) ** inflation
    keep = (s > 0) & ((s >= prune * s.sum(0)) | (s >= (1 - 1e-9) * s.max(0)))
    s = np.where(keep, s, 0)
    return s / s.sum(0)


def matrix_of(df, n):
    m = np.zeros((n, n))
    for r in df.collect():
        assert m[r.i, r.j] == 0
        m[r.i, r.j] = r.v
    return m


@pytest.mark.parametrize("hub,share,prune", [(512, 1 << 20, 1e-3), (3, 7, 1e-3), (1, 1, 0.05)])
def test_round_with_hubs_dealt(spark, hub, share, prune):
    n = 30
    edges = spark.createDataFrame(graph(n), "a long, b long")
    matrix = cut_lineage(G.stochastic_matrix(edges))
    want = matrix_of(matrix, n)
    assert np.allclose(want.sum(0), 1)
    for _ in range(2):
        want = dense_round(want, 2.5, prune)
        matrix = cut_lineage(G.markov_round(matrix, 2.5, prune, hub, share))
        assert np.allclose(matrix_of(matrix, n), want)


def test_hub_products_are_dealt(spark):
    """No key of the expansion holds a hub's whole row and column."""
    n = 40
    star = spark.createDataFrame([(0, i) for i in range(1, n)], "a long, b long")
    matrix = cut_lineage(G.stochastic_matrix(star))
    whole = G._products(matrix, 8, 1 << 20).groupBy("j", "s").count().agg({"count": "max"}).first()[0]
    dealt = G._products(matrix, 8, 20).groupBy("j", "s").count().agg({"count": "max"}).first()[0]
    assert whole >= 2 * n - 1 and dealt <= whole / 1.5
    assert G._products(matrix, 8, 20).count() == G._products(matrix, 512, 1 << 20).count()


def test_clusters_settle_or_fail(spark):
    two = [(a, b) for g in (0, 10) for a in range(g, g + 5) for b in range(a + 1, g + 5)] + [(4, 10)]
    edges = spark.createDataFrame(two, "a long, b long")
    got = {r.vertex: r.cluster for r in G.markov_cluster(edges, 2.5, 1e-3).collect()}
    assert len({got[v] for v in range(5)}) == 1 and len({got[v] for v in range(10, 15)}) == 1 and got[0] != got[12]
    with pytest.raises(ValueError):
        G.markov_cluster(edges, 2.5, 1e-3, max_rounds=1)
    assert G.markov_cluster(edges.filter("a > 99")).collect() == []


def test_release_removes_a_stored_table(spark):
    stored = cut_lineage(spark.range(5).toDF("x"))
    assert stored.count() == 5
    release(stored)
    release(spark.range(3))
    with pytest.raises(Exception):
        spark.read.schema("x long").parquet(stored._stored_at).collect()


@pytest.mark.parametrize("step,share", [(1 << 20, 1 << 20), (50, 1 << 20), (1, 40)])
def test_blocks_add_up_in_steps(spark, step, share, monkeypatch):
    """A square is added up in its blocks, in tables of cells or by sorting, and no product becomes a row of its own."""
    n = 60
    edges = spark.createDataFrame(graph(n, 5), "a long, b long")
    matrix = cut_lineage(G.stochastic_matrix(edges))
    monkeypatch.setattr(G, "_expand", lambda inflation, prune, make=G._expand: make(inflation, prune, step))
    monkeypatch.setattr(G, "_products", None)
    want = dense_round(matrix_of(matrix, n), 2.5, 1e-3)
    got = G.markov_round(matrix, 2.5, 1e-3, 512, share)
    assert np.allclose(matrix_of(got, n), want)
