import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as C
from featuremill.llm import quality

from .helpers import LOWER, awkward, empty
from .test_mixing_sharding_dedup import plain_mix, words
from .test_packing import ids_of
from .test_simhash import brute, components


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def plain_rest(kept):
    """What the stages after the classifier make of (doc_id, text, source) rows, in plain Python: texts of the mix."""
    best = {}
    for d, t, s in kept:
        best[t.translate(LOWER)] = max(best.get(t.translate(LOWER), (-1, "", "")), (d, t, s))
    exact = list(best.values())
    roots = components([(d, brute(t)) for d, t, _ in exact])
    near = [r for r in exact if roots[r[0]] == r[0]]
    _, taken = plain_mix([(d, s, words(t)) for d, t, s in near])
    return exact, near, {d: taken[(d, s)][0] for d, _, s in near}


def test_pipeline_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(C.STAGES)
    good = stages["quality"](spark, docs, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    want = {r.doc_id for r in docs.collect() if model.score([r.text])[0] >= 0.5}
    assert set(rows_of(good)) == want and good.columns == docs.columns
    assert np.mean([r.doc_id in want for r in labels.filter("quality = 1").collect()]) > 0.9
    assert np.mean([r.doc_id in want for r in labels.filter("quality = 0").collect()]) < 0.1
    exact, near, taken = plain_rest([(r.doc_id, r.text, r.source) for r in good.collect()])
    second = stages["exact_dedup"](spark, good, sf)
    assert {(r.doc_id, r.text) for r in second.collect()} == {(d, t) for d, t, _ in exact}
    third = stages["near_dedup"](spark, second, sf)
    assert {(r.doc_id, r.text) for r in third.collect()} == {(d, t) for d, t, _ in near}
    fourth = stages["mixing"](spark, third, sf)
    assert fourth.columns == docs.columns
    got = {}
    mixed = fourth.collect()
    for r in mixed:
        got[r.doc_id] = got.get(r.doc_id, 0) + words(r.text)
    assert got == {d: n for d, n in taken.items() if n}
    packed = entry.queries()["pipeline"](spark, sf).collect()
    assert sum(r.length for r in packed) == sum(len(ids_of(r.text)) for r in mixed)
    assert sorted({r.doc_id for r in packed}) == sorted(got)


def test_stages_on_awkward_and_empty_tables(spark, sf):
    plain = awkward(spark, extra=False)
    for name, stage in C.STAGES[:-1]:
        for docs in (awkward(spark), plain):
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            assert out.count() >= 0
        assert stage(spark, empty(spark), sf).count() == 0
    assert C.STAGES[-1][1](spark, empty(spark), sf).count() == 0
