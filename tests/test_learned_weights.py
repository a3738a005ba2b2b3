"""Weights learned under a total-variation penalty."""

import itertools
import math

import numpy as np
import pytest

from featuremill.operators import multiple_testing as MT


def simulate(rng, n, tiles, shares, effect=1e-4):
    """p-values whose share of effects depends on the tile; the last array says which are none."""
    tile = np.arange(n) % tiles
    real = rng.random(n) < np.array(shares)[tile]
    p = np.where(real, rng.random(n) * effect, rng.random(n))
    return tile, p, ~real


def on_spark(spark, tile, p):
    rows = [(i, float(t) * 1000 + i / len(p), float(x)) for i, (t, x) in enumerate(zip(tile, p))]
    return spark.createDataFrame(rows, "feature long, base_mean double, p double")


@pytest.mark.parametrize("cost", [0.0, 0.7, 3.0, math.inf])
def test_dynamic_programme_against_all_choices(cost):
    rng = np.random.default_rng(4)
    edges = np.sort(rng.random(5))
    for _ in range(20):
        gain = rng.normal(size=(4, 5))
        value = lambda at: gain[range(4), at].sum() - (0 if len(set(at)) == 1 else cost * np.abs(np.diff(edges[list(at)])).sum())
        best = max(value(at) for at in itertools.product(range(5), repeat=4) if not math.isinf(cost) or len(set(at)) == 1)
        assert value(tuple(MT.penalised_thresholds(gain, edges, cost))) == pytest.approx(best)


def test_rejections_of_a_histogram():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 4, (3, MT._CELLS)).astype(float)
    counts[0, :60] += 9
    w = np.array([2.0, 0.5, 0.0])
    m = counts.sum(1)
    w = w / ((w * m).sum() / m.sum())
    tests = [MT._EDGES[c + 1] / w[t] if w[t] else math.inf for t in range(3) for c in range(MT._CELLS) for _ in range(int(counts[t, c]))]
    tests.sort()
    want = max([i + 1 for i, q in enumerate(tests) if q * len(tests) <= 0.05 * (i + 1)], default=0)
    assert MT.histogram_rejections(counts, np.array([2.0, 0.5, 0.0]), 0.05) == want > 0


def test_no_signal_gives_equal_weights(spark):
    rng = np.random.default_rng(6)
    even = MT.learned_weights(on_spark(spark, *simulate(rng, 4000, 5, [0.05] * 5)[:2]), 5, 5, 0.1).toPandas()
    assert even.groupby("tile").weight.mean().between(0.5, 1.6).all() and np.median(even.weight) == pytest.approx(1.0, abs=0.2)
    none = MT.learned_weights(on_spark(spark, np.arange(2000) % 5, rng.random(2000)), 5, 5, 0.1).toPandas()
    assert none.weight.between(0.5, 1.6).mean() > 0.7


def test_signal_raises_rejections_and_keeps_the_rate(spark):
    plain = weighted = false = 0
    for seed in range(3):
        tile, p, null = simulate(np.random.default_rng(seed), 6000, 6, [0, 0, 0.01, 0.03, 0.15, 0.3], effect=0.01)
        df = on_spark(spark, tile, p)
        a = MT.bh_adjust(df).filter("padj <= 0.1").count()
        got = [r.feature for r in MT.ihw(df, 6, 5, 0.1).filter("padj <= 0.1").collect()]
        plain, weighted, false = plain + a, weighted + len(got), false + int(null[got].sum())
    assert weighted > 1.1 * plain and false <= 0.14 * weighted


def test_strong_penalty_is_chosen_without_gain():
    rng = np.random.default_rng(8)
    flat = {f: rng.multinomial(400, np.full(MT._CELLS, 1 / MT._CELLS), size=4).astype(float) for f in range(3)}
    assert MT.choose_penalty({f: np.zeros_like(h) for f, h in flat.items()}, 0.1) == math.inf
    assert (MT.tile_weights(sum(flat.values()), 0.1, math.inf) == 1).all()
