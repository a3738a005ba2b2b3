import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from featuremill.llm import hardneg as H

VECTORS = "vec_id long, embedding array<double>, label int"


def brute(rows, anchor, positives=5, negatives=10, low=30, high=90, scale=256):
    """rows: (id, vector, label) in the order of the table."""
    good = [(i, d, [max(-(2**63), min(2**63 - 1, math.floor(scale * x))) for x in v], y) for i, (d, v, y) in enumerate(rows) if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda s: (-s[0], s[1] is None, s[1] or 0, s[2])
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    out = []
    for i, d, v, y in good:
        if d is None or not anchor(d):
            continue
        scores = [(clip(sum(a * b for a, b in zip(v, w))), e, j, z) for j, e, w, z in good if j != i]
        for p, pid, _, _ in sorted([s for s in scores if s[3] == y], key=order)[:positives]:
            hard = [s for s in scores if s[3] != y and low * p <= 100 * s[0] <= high * p]
            out += [(d, pid, r + 1, s[1], p, s[0]) for r, s in enumerate(sorted(hard, key=order)[:negatives])]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(size=6).tolist(), int(rng.integers(3))) for i in range(60)]
    rows += [(100, [0.5] * 6, None), (101, None, 1), (102, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (103, [float("nan")] * 6, 0), (104, [float("inf")] + [0.0] * 5, 0), (None, [0.4] * 6, 1)]
    rows += [(105, [], 1), (106, [0.0] * 6, 2), (107, [0.3, 0.2], 0), (107, [0.3, 0.2], 0), (20, rows[20][1], rows[20][2]), (110, [-0.1] * 6, 1), (120, [], 0)]
    df = spark.createDataFrame(rows, VECTORS).coalesce(1)
    for c in ("row", "id", "v", "anchor", "cluster", "list", "part", "group", "span", "score", "rank", "positives", "anchor_id"):
        df = df.withColumn(c, F.lit(c))
    want = brute(rows, lambda d: d % 10 == 0)
    assert found(H.mine(df, F.col("vec_id") % 10 == 0)) == want and len(want) > 50
    assert found(H.mine(df, F.col("vec_id") % 10 == 0, part_bytes=800, cell_anchors=2)) == want


def test_no_anchor_and_no_row(spark):
    df = spark.createDataFrame([(1, [0.5], 1)], VECTORS)
    assert H.mine(df, F.col("vec_id") == 7).collect() == [] and H.mine(df.filter("false"), F.lit(True)).collect() == []
    assert H.mine(df, F.lit(True)).collect() == []


def test_huge_components(spark):
    rows = [(0, [3e15, 1.0], 0), (1, [2e15, 2.0], 0), (2, [1.5e15, 0.5], 1), (3, [1e300, -1e300], 1), (4, [-1e18, 1e18], 0), (5, [1e-3, 1e3], 1)]
    df = spark.createDataFrame(rows, VECTORS).coalesce(1)
    assert found(H.mine(df, F.lit(True))) == brute(rows, lambda d: True)


def test_hot_vector_and_hot_label(spark):
    rng = np.random.default_rng(1)
    same = rng.normal(size=4).tolist()
    rows = [(i, same if i % 3 else rng.normal(size=4).tolist(), 1 if i % 2 else int(rng.integers(4))) for i in range(600)]
    df = spark.createDataFrame(rows, VECTORS).coalesce(1)
    assert found(H.mine(df, F.col("vec_id") % 50 == 0, part_bytes=4000)) == brute(rows, lambda d: d % 50 == 0)


def test_string_labels_and_ids(spark):
    rng = np.random.default_rng(2)
    rows = [(f"v{i:03d}", rng.normal(size=3).tolist(), "ab"[i % 2]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, label string").coalesce(1)
    assert found(H.mine(df, F.col("vec_id").endswith("0"))) == brute(rows, lambda d: d.endswith("0"))


def test_walks_end_early():
    """Two far clusters: members of one never reach the other's rows."""
    rng = np.random.default_rng(3)
    near, far = np.array([5.0] + [0.0] * 7), np.array([0.0] * 7 + [5.0])
    v = np.concatenate([near + rng.normal(size=(4000, 8)) / 20, far + rng.normal(size=(4000, 8)) / 20])

    def side(rows):
        table = pa.table({"v": pa.array((rows * 256).round().astype(int).tolist()), "row": np.arange(len(rows)), "label": np.zeros(len(rows), int)})
        return H._Side(table, 8)

    members = side(v[:20])
    best, scored = H.walk(side(v), members, near / 5, [[(-H._LONG - 1, H._LONG)]] * 20, 5, lambda m, at: np.ones(len(at), bool))
    assert scored <= 0.6 * 20 * 8000
    whole = members.v @ side(v).v.T
    assert [[-s for s, _ in b[0]] for b in best] == np.sort(whole, 1)[:, ::-1][:, :5].astype(int).tolist()
