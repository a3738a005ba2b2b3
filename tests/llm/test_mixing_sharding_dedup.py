import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from featuremill.llm import exactdedup as X
from featuremill.llm import mixing as M
from featuremill.llm import sharding as S

from .helpers import DOCS, LOWER, awkward, column_rows, empty, groups

# Sharding -------------------------------------------------------------------------------------


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_against_the_published_loop():
    rng = random.Random(1)
    keys = np.array([rng.getrandbits(64) for _ in range(500)] + [0, 2**64 - 1], np.uint64)
    for n in (1, 2, 8, 9, 1000, 1 << 20):
        assert S.jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]
    with pytest.raises(ValueError):
        S.jump(keys, 0)


def test_sharding_query(spark, sf):
    docs = dict(column_rows(sf, "documents", "doc_id", "text"))
    rows = entry.queries()["op1_sharding"](spark, sf).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)
    for own in groups((r.shard, r) for r in rows).values():
        assert [r.slot for r in sorted(own, key=lambda r: r.doc_id)] == list(range(len(own)))


def test_sharding_awkward_and_empty(spark, tmp_path):
    df = awkward(spark)
    out = S.assign_shards(df, ["doc_id"], 3)
    assert out.count() == df.count() and set(df.columns) == set(out.columns) and {r.slot for r in out.collect()} != {"slot"}
    for own in groups((r.shard, r.slot) for r in out.collect()).values():
        assert sorted(own) == list(range(len(own)))
    assert S.assign_shards(empty(spark), ["doc_id"], 3).count() == 0
    S.write_shards(df.drop("shard"), ["doc_id"], 3, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted((str(r.doc_id), r.shard) for r in back.collect()) == sorted((str(r.doc_id), r.shard) for r in out.collect())


# Exact copies ---------------------------------------------------------------------------------


def test_decisions_on_awkward_rows(spark):
    df = awkward(spark)
    got = X.decide(df).collect()
    assert len(got) == df.count()
    by = groups(((r.text or "").translate(LOWER), r.doc_id) for r in df.collect())
    for t, ids in by.items():
        own = [r for r in got if r.digest == hashlib.sha256(t.encode()).hexdigest()]
        best = max((i for i in ids if i is not None), default=None)
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in own)
        assert {(r.keep_id, r.group_size) for r in own} == {(best, len(ids))} and [r.doc_id for r in own if r.kept] == [best]
    assert X.decide(empty(spark)).count() == 0


@pytest.mark.parametrize("digest", [lambda c: F.length(c).cast("string"), lambda c: F.lit("same")])
def test_a_digest_that_clashes_merges_nothing(spark, digest):
    df = awkward(spark)
    plain, weak = X.decide(df), X.decide(df, digest=digest)
    key = ["doc_id", "keep_id", "group_size", "kept"]
    assert sorted(map(str, plain.select(*key).collect())) == sorted(map(str, weak.select(*key).collect()))
    assert sorted(map(str, X.keep_winners(df).collect())) == sorted(map(str, X.keep_winners(df, digest=digest).collect()))


def test_winners(spark):
    df = awkward(spark)
    rows = X.keep_winners(df).collect()
    best = {}
    for r in df.collect():
        t = (r.text or "").translate(LOWER)
        if t not in best or (r.doc_id is not None and (best[t].doc_id is None or r.doc_id > best[t].doc_id)):
            best[t] = r
    assert sorted(map(str, rows)) == sorted(map(str, best.values()))
    assert X.keep_winners(empty(spark)).count() == 0 and X.keep_winners(df).columns == df.columns


def test_hot_group(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Copy").otherwise(F.concat(F.lit("t"), "id")).alias("text")).repartition(9)
    rows = X.decide(df).filter("group_size > 1").agg(F.count(F.lit(1)), F.max("group_size"), F.count_if("kept"), F.min("keep_id")).first()
    assert tuple(rows) == (6667, 6667, 1, 19998)


# Mixing ---------------------------------------------------------------------------------------


def plain_mix(docs, weights=(5, 2, 1), share=Fraction(3, 2), epochs=2, seed=0):
    """(target by source, taken by document) with whole fractions."""
    size = {}
    for _, s, n in docs:
        size[s] = size.get(s, 0) + n
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(size.values()), set()
    while True:
        open_ = [s for s in order if s not in full]
        rest = total - sum(epochs * size[s] for s in full)
        target = {s: Fraction(epochs * size[s]) if s in full else rest * w[s] / sum(w[x] for x in open_) for s in order}
        more = {s for s in open_ if target[s] > epochs * size[s]}
        if not more:
            break
        full |= more
    taken = {}
    for s in order:
        goal = int(target[s])
        whole = goal // size[s] if size[s] else 0
        rest = goal - whole * size[s]
        for d, n in sorted(((d, n) for d, x, n in docs if x == s), key=lambda r: (hashlib.md5(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])):
            extra = min(n, rest)
            rest -= extra
            taken.setdefault((d, s), []).append(whole * n + extra)
    return {s: float(t) for s, t in target.items()}, taken


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.mark.parametrize("cell", [2000, 3])
def test_mix_against_plain(spark, sf, monkeypatch, cell):
    monkeypatch.setattr(M, "ROWS_PER_CELL", cell)
    docs = [(d, s, words(t)) for d, s, t in column_rows(sf, "documents", "doc_id", "source", "text")]
    target, taken = plain_mix(docs)
    rows = entry.queries()["op8_mixing"](spark, sf).collect()
    source = {d: s for d, s, _ in docs}
    assert len(rows) == len(docs)
    for r in rows:
        assert r.target == pytest.approx(target[source[r.doc_id]], rel=1e-12) and [r.taken] == taken[(r.doc_id, source[r.doc_id])] and r.taken <= 2 * r["size"]
    by = groups((source[r.doc_id], r.taken) for r in rows)
    assert all(abs(sum(x) - target[s]) < 1 for s, x in by.items())


def test_mix_awkward_and_empty(spark):
    df = awkward(spark).withColumn("words", M.word_count(F.col("text")))
    out = M.mix(df, "words")
    made = ["source_size", "target", "taken"]
    assert out.columns == [*[c for c in df.columns if c not in made], *made] and out.count() == df.count()
    with pytest.raises(ValueError):
        M.mix(df, "taken")
    target, taken = plain_mix([(r.doc_id, r.source, r.words) for r in df.collect()])
    for r in out.collect():
        assert r.target == pytest.approx(target[r.source]) and r.taken in taken[(r.doc_id, r.source)]
    mixed = M.repeat_mixed(out, "words", n_chars="n_chars").collect()
    assert sum(words(r.text) for r in mixed) == sum(sum(x) for x in taken.values())
    whole = {r.text for r in df.collect()}
    assert all(r.text in whole or any(w is not None and w.startswith(r.text) and len(r.text) == r.n_chars for w in whole) for r in mixed)
    assert M.mix(empty(spark).withColumn("words", F.lit(1)), "words").count() == 0
    none = spark.createDataFrame([(1, None, None, "a", 0)], DOCS).withColumn("words", F.lit(0))
    assert M.mix(none, "words").first().taken == 0


def test_mix_where_all_caps_are_reached(spark):
    df = spark.createDataFrame([(i, "x", None, "ab"[i % 2], 1) for i in range(10)], DOCS).withColumn("words", F.lit(1))
    assert {r.taken for r in M.mix(df, "words", share=(5, 1)).collect()} == {2}
