import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from featuremill.llm import simhash as S

from .helpers import LOWER, Union, awkward, column_rows, empty, groups


def brute(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    u = Union()
    by = groups((fp, d) for d, fp in fps)
    reps = [(fp, min(d)) for fp, d in by.items()]
    arr = np.array([fp for fp, _ in reps], np.uint64)
    for i in range(len(arr)):
        u.find(reps[i][1])
        for j in np.flatnonzero(np.bitwise_count(arr[i] ^ arr[i + 1 :]) <= 3):
            u.join(reps[i][1], reps[i + 1 + int(j)][1])
    low = dict(reps)
    return {d: u.find(low[fp]) for d, fp in fps}


def test_query_against_brute_force(spark, sf):
    docs = column_rows(sf, "documents", "doc_id", "text")
    fps = [(d, brute(t)) for d, t in docs]
    want = components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in entry.queries()["op10_simhash"](spark, sf).collect()}
    assert got == {d: (f"{fp:016x}", want[d]) for d, fp in fps}


def test_long_text_in_pieces_and_spark_hash(spark, monkeypatch):
    text = "Some words, again and AGAIN the same\n" * 300
    monkeypatch.setattr(S, "_PIECE", 97)
    assert S.simhash(text) == brute(text)
    assert spark.range(1).select(F.xxhash64(F.lit("été b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("été b c".encode(), 42)


def test_keys_meet_for_every_error_within_three_bits():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    for x in base:
        places = list(itertools.islice(itertools.combinations(rng.sample(range(64), 20), 3), 300)) + [(a,) for a in range(64)] + [(a, a + 1) for a in range(63)]
        near = np.array([x, *[x ^ sum(1 << b for b in p) for p in places]], np.uint64)
        at, keys = S.keys_of(near)
        mine = set(keys[at == 0])
        for i in range(1, len(near)):
            assert mine & set(keys[at == i])


def test_dense_group_beyond_a_block(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    near = {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}  # within four bits of one another, two of the centre
    far = {rng.getrandbits(64) for _ in range(300)}
    fps = sorted(near | far)
    rows = [(i, int(np.uint64(fp).astype(np.int64))) for i, fp in enumerate(fps)]
    got = dict((r.doc_id, r.component_id) for r in S.group_near(spark.createDataFrame(rows, "doc_id long, fp long")).collect())
    assert got == components([(i, fp) for i, fp in enumerate(fps)])


def test_chain_is_one_component(spark):
    fps, x = [], 0
    for i in range(60):
        fps.append(x)
        x ^= 7 << (i % 20 * 3)
    rows = [(i, int(np.uint64(fp).astype(np.int64))) for i, fp in enumerate(fps)]
    got = dict((r.doc_id, r.component_id) for r in S.group_near(spark.createDataFrame(rows, "doc_id long, fp long")).collect())
    assert got == components([(i, fp) for i, fp in enumerate(fps)])


def test_awkward_and_empty(spark):
    docs = awkward(spark).drop("fp").withColumn("fp", S.fingerprint(F.col("text")))
    out = S.group_near(docs)
    assert out.columns == [*[c for c in docs.columns if c != "component_id"], "component_id"] and out.count() == docs.count()
    by = {r.doc_id: r.component_id for r in out.collect()}
    assert by[3] == by[4] == by[5] == 3 and by[2] == by[1] == 1 and by[None] is None
    kept = S.keep_one_of_each(awkward(spark))
    assert kept.columns == awkward(spark).columns
    rows = [(d, brute(t)) for d, t in {(r.doc_id, r.text) for r in docs.collect()} if d is not None]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(components(rows).values()))
    assert sum(r.doc_id is None for r in kept.collect()) == 1
    assert S.keep_one_of_each(empty(spark)).count() == 0
