import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from featuremill.llm import langid as L
from featuremill.llm import quality as Q

from .helpers import awkward, column_rows, empty

BIG = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = {d: (t, lang) for d, t, lang in column_rows(BIG, "documents", "doc_id", "text", "lang")}
    rows = entry.queries()["op3_language"](spark, BIG).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in docs[r.doc_id][0]))
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id][1] for r in held]) > 0.97


def test_tables_are_the_network_and_gradients_fit():
    rng = np.random.default_rng(2)
    net = L.Network.new(["a", "b", "c"])
    x = rng.integers(0, 256, (7, L.WINDOW)).astype(np.uint8)
    y = rng.integers(0, 3, 7)
    weight = np.ones(7, np.float32)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}

    def plain():
        h = []
        for w in L.WIDTHS:
            e = net.params["embed"][x]
            f = net.params[f"filter{w}"].reshape(w, L.EMBED, -1)
            a = sum(e[:, o : L.WINDOW - w + 1 + o] @ f[o] for o in range(w)) + net.params[f"bias{w}"]
            h.append(np.maximum(a.max(1), 0))
        z = np.concatenate(h, 1) @ net.params["out"] + net.params["out_bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    assert np.allclose(net.probabilities(x, net.tables()), plain())
    g = net.step(x, y, weight)
    loss = lambda: -np.log(plain()[np.arange(7), y]).mean()
    for k in net.params:
        flat = net.params[k].reshape(-1)
        for i in np.argsort(-np.abs(g[k].reshape(-1)))[:3]:
            if k == "embed" and i < L.EMBED:
                continue
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert (up - down) / 2e-5 == pytest.approx(g[k].reshape(-1)[i], rel=1e-3, abs=1e-6)


def test_language_awkward_and_empty(spark):
    docs = awkward(spark)
    net = L.train(docs)
    assert net.languages == ["de", "en", "fr"]
    out = L.identify(docs, net)
    rows = out.collect()
    assert out.columns == [*docs.columns, "lang_pred", "score"] and len(rows) == docs.count()
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (3, 4, 5)} == {3: "und", 4: "und", 5: "und"}
    assert all((r.score == 0) == (r.lang_pred == "und") for r in rows)
    assert L.train(empty(spark)) is None and L.identify(empty(spark), None).count() == 0
    assert {r.lang_pred for r in L.identify(docs, None).collect()} == {"und"}


def test_windows_cover_a_whole_text():
    text = "Aé" * 1000
    assert L.windows_of(text).tobytes().rstrip(b"\0") == text.lower().encode() and L.windows_of("").shape == (1, L.WINDOW)


def test_quality_held_out(spark):
    docs = dict(column_rows(BIG, "documents", "doc_id", "text"))
    labels = dict(column_rows(BIG, "labels", "doc_id", "quality"))
    rows = entry.queries()["op9_quality"](spark, BIG).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 80 and np.mean([p == y for p, y in held]) > 0.95


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(3)
    lines = np.array([1, 4, 2, 5])
    odds, moves = rng.normal(0, 2, lines.sum()), rng.normal(0, 1, (2, 2))
    good, _, _ = Q.forward_backward(odds, lines, moves)
    at = 0
    for n in lines:
        total, on = 0.0, np.zeros(n)
        for ys in itertools.product((0, 1), repeat=int(n)):
            s = np.exp(sum(odds[at + i] * y for i, y in enumerate(ys)) + sum(moves[a, b] for a, b in zip(ys, ys[1:])))
            total, on = total + s, on + s * np.array(ys)
        assert np.allclose(good[at : at + n], on / total)
        at += n


def test_line_features_of_plain_lines():
    texts = ["Two words. Two\nSAME same same line!!\n\nlong enough line\nlong enough line", "", "x"]
    x, size, lines = Q.line_features(texts)
    assert lines.tolist() == [5, 1, 1] and size.sum() == sum(len(t.encode()) + 1 for t in texts)
    words = [len(line.split()) for t in texts for line in t.split("\n")]
    assert np.allclose(x[:, 12], np.array(words) / 20) and x[1, 7] == pytest.approx(1 / 4)
    assert x[:, 9].tolist() == [0, 0, 0, 1, 1, 0, 0] and x[:, 11].tolist() == [0, 0, 1, 0, 0, 1, 0]
    rng = random.Random(1)
    parts = ["".join(rng.choice("aB 1.|\n!é") for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    x, _, lines = Q.line_features(parts)
    assert np.allclose(x, np.concatenate([Q.line_features([p])[0] for p in parts])) and lines.tolist() == [p.count("\n") + 1 for p in parts]


def test_quality_awkward_and_empty(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (6, 0), (8, 1), (None, 1), (3, None), (99, 0)], "doc_id long, quality int")
    model = Q.train(docs, labels)
    out = Q.classify(docs, model)
    rows = out.collect()
    assert out.columns == [*docs.columns, "score", "predicted"] and len(rows) == docs.count()
    assert all(0 <= r.score <= 1 for r in rows)
    lines = docs.select("text", Q.line_quality(F.col("text"), model).alias("p")).collect()
    assert all(len(r.p) == (r.text or "").count("\n") + 1 for r in lines)
    none = Q.train(docs, labels.filter("doc_id > 1000"))
    assert {r.score for r in Q.classify(docs, none).collect()} == {0.5}
    assert Q.classify(empty(spark), model).count() == 0
