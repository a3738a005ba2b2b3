import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from featuremill.llm import editprint as E

from .helpers import Union, awkward, column_rows, empty


def slow_print(text):
    """The walk taken step by step, one text at a time."""
    coin = np.random.default_rng(E.SEED).integers(0, 2, (E.CLASSES, E.PERIOD), dtype=np.uint8)
    coin[:, -1] = 1
    shown, i, step = [], 0, 0
    codes = [ord(c) for c in text]
    while i < len(codes):
        shown.append(i)
        i += int(coin[(codes[i] * 2654435761 % 2**32) >> 24, step % E.PERIOD])
        step += 1
    out = bytearray()
    for records in E._records():
        below = records[records < len(shown)]
        at = shown[below[-1]] if len(below) else 0
        h = 0
        for k in range(E.SPAN):
            h = (h * 0x01000193 + (codes[at + k] + 1 if at + k < len(codes) else 0)) % 2**32
        h ^= h >> 15
        out.append((h * 0x2C1B3C6D % 2**32) >> 24)
    return bytes(out)


def test_query_against_brute_force(spark, sf):
    docs = sorted(column_rows(sf, "documents", "doc_id", "text"))
    got = {r.doc_id: r for r in entry.queries()["op2_edit_fingerprint"](spark, sf).collect()}
    assert len(got) == len(docs)
    near, apart = [], []
    prints = [slow_print(t) for _, t in docs]
    for i, (d, t) in enumerate(docs):
        j = (i + 1) % len(docs)
        q = len(t) // 4
        edited = t[: len(t) - q] + docs[j][1][:q]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (prints[i].hex(), slow_print(edited).hex())
        like = lambda a, b: sum(x == y for x, y in zip(a, b)) / len(a)
        assert r.near_edited == like(prints[i], slow_print(edited)) and r.near_next == like(prints[i], prints[j])
        near.append(r.near_edited)
        apart.append(r.near_next)
    assert np.mean(near) > 0.7 and np.mean(apart) < 0.1
    assert np.mean(np.array(near) > np.array(apart)) > 0.98


def test_likeness_falls_with_edits():
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    seen = []
    for n in (0, 1, 5, 40, 400, 2000):
        t = list(text)
        for _ in range(n):
            t[rng.randrange(len(t))] = rng.choice(["", "x", "yz"])
        a, b = E.fingerprints([text, "".join(t)])
        seen.append(E.likeness(a, b))
    assert seen[0] == 1 and seen[1] > 0.8 and seen[-1] < 0.2 and all(x >= y - 0.05 for x, y in zip(seen, seen[1:]))


def test_few_and_many_lanes_agree(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(chr(rng.randrange(32, 1200)) for _ in range(rng.randrange(0, 90))) for _ in range(80)]
    a = E.fingerprints(texts)
    monkeypatch.setattr(E, "_FEW", 10**6)
    assert (a == E.fingerprints(texts)).all()
    assert [bytes(x) for x in a] == [slow_print(t) for t in texts]


def test_awkward_and_empty(spark):
    df = awkward(spark)
    rows = E.compare_with_next(df).collect()
    assert len(rows) == df.count()
    order = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect()))
    want = {}
    for i, (_, d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][2]
        want.setdefault(d, []).append(hashlib.sha256((t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]).encode()).hexdigest())
    got = {}
    for r in rows:
        got.setdefault(r.doc_id or 0, []).append(r.edited_sha256)
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in want.items()}
    assert E.compare_with_next(empty(spark)).count() == 0
    one = E.compare_with_next(df.filter("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_string_ids(spark):
    rows = [(f"d{i}", f"text of {i} " * (i % 5)) for i in range(30)] + [(None, "x")]
    got = E.compare_with_next(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or ""))
    want = {}
    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        want[d] = hashlib.sha256((t[: len(t) - len(t) // 4] + n[: len(t) // 4]).encode()).hexdigest()
    assert {r.doc_id: r.edited_sha256 for r in got} == want


def test_groups_against_all_pairs(spark, sf):
    """Every pair at 0.8 or more is linked, and no other."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = random.Random(9)
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    for d, t in texts[:60]:
        for n in (2, 8, 30):
            edited = list(t)
            for _ in range(n if t else 0):
                edited[rng.randrange(len(edited))] = rng.choice("qz")
            texts.append((10_000 + 100 * d + n, "".join(edited)))
    prints = E.fingerprints([t for _, t in texts])
    up = Union()
    for i in range(len(texts)):
        for j in np.flatnonzero(E.likeness(prints[i], prints) >= 0.8):
            up.join(texts[i][0], texts[int(j)][0])
    df = spark.createDataFrame([(d, p.tobytes().hex(), "x") for (d, _), p in zip(texts, prints)], "doc_id long, fingerprint string, component_id string")
    got = {r.doc_id: r.component_id for r in E.near_groups(df).collect()}
    assert got == {d: up.find(d) for d, _ in texts} and len(set(got.values())) < len(texts) - 60


def test_near_groups(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefghij ") for _ in range(600)) for _ in range(30)]
    rows = [(10 * i, t) for i, t in enumerate(texts)] + [(10 * i + 1, t + " end") for i, t in enumerate(texts)] + [(10 * i + 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", E.fingerprint(F.col("text")))
    got = {r.doc_id: r.component_id for r in E.near_groups(df).collect()}
    assert got == {d: d // 10 * 10 for d, _ in rows}
    assert E.near_groups(df.filter("doc_id < 0")).count() == 0
