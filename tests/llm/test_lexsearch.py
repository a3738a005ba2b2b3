import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from featuremill.llm import lexsearch as L

from .helpers import LOWER, awkward, empty

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    """docs: (id, text), items: (key, text). For each key the (rank, id, score) rows."""
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n, total = len(counted), sum(x for _, _, x in counted)
    df = Counter(w for _, c, _ in counted for w in c)
    out = []
    for key, text in items:
        scores = []
        for d, c, length in counted:
            m = 75 + 25 * length * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in terms(text) if w in c)
            if s > 0:
                scores.append((-s, d is None, d if d is not None else 0))
        out += [(key, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:k])]
    return out


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_awkward_rows(spark):
    docs = awkward(spark)
    items = [(1, "beta GAMMA beta"), (2, None), (3, ""), (4, "word another plain"), (None, "orphan ß été"), (5, "nothing-of-this"), (6, "one"), (6, "alpha")]
    got = found(L.search(docs, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS rank", "'y' AS score"), k=3))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got == sorted(brute(rows, items, 3), key=str)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert L.search(empty(spark), items).columns == ["item_id", "rank", "doc_id", "score"]
    assert found(L.search(empty(spark), items)) == []
    assert found(L.search(awkward(spark), items.filter("false"))) == []


def test_whole_table_in_one_pass_and_in_many(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = sorted(brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]), key=str)
    assert found(L.search(docs, items)) == want
    assert found(L.search(docs.repartition(5), items.limit(12), block_bytes=2000, cells=4000)) == [r for r in want if r[0] in {i.item_id for i in items.limit(12).collect()}]


def test_string_ids_and_hot_copies(spark):
    rows = [(f"d{i:04d}", "same words in many copies") for i in range(400)] + [("z", "same words but rare ones"), ("a", "same words in many copies")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    items = [(1, "rare same words copies"), (2, "many")]
    assert found(L.search(docs, spark.createDataFrame(items, "item_id long, text string"), cells=500)) == sorted(brute(rows, items), key=str)


def test_terms_of_long_texts():
    text = ("Ab-c" * 700_000 + " tail é").encode()
    assert [w for ws in L.terms_of(text) for w in ws] == [w.encode() for w in terms(text.decode())]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 11), st.integers(1, 10**9), min_size=1, max_size=6), min_size=1, max_size=60), st.lists(st.dictionaries(st.integers(0, 11), st.integers(1, 5), min_size=1, max_size=5), min_size=1, max_size=5), st.integers(1, 7))
def test_bounds_are_never_below_a_score(points, queries, k):
    def sparse(rows):
        flat = [(t, v) for r in rows for t, v in sorted(r.items())]
        return L.Sparse(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.array([t for t, _ in flat]), np.array([v for _, v in flat]))

    x, items = sparse(points), L.Items(list(range(len(queries))), sparse(queries), np.arange(12) * 900, 1, 1)
    tree = L.build(x, items, leaf=3)
    order = np.concatenate(tree.order)
    assert sorted(order.tolist()) == list(range(len(points)))
    scores = np.array([[sum(v * p.get(t, 0) for t, v in q.items()) for p in points] for q in queries], dtype=object)
    below = {}

    def rows(node):
        if node not in below:
            below[node] = order[slice(*tree.runs[node])].tolist() if not tree.children[node] else [r for c in tree.children[node] for r in rows(c)]
        return below[node]

    for node in range(len(tree.bounds)):
        assert all(tree.bounds[node][j] >= max(scores[j][rows(node)]) for j in range(len(queries)))
    for j in range(len(queries)):
        dense = np.zeros(12, np.int64)
        for t, v in queries[j].items():
            dense[t] = v
        best, _ = L.walk(tree, x.take(order), dense, j, k, 0, [np.array([i]) for i in order])
        assert best == sorted((-int(s), i) for i, s in enumerate(scores[j]) if s > 0)[:k]


def test_subtrees_are_left_out(sf):
    import pyarrow.parquet as pq

    docs, items = pq.read_table(f"{sf}/documents.parquet"), pq.read_table(f"{sf}/benchmark.parquet")
    known, counted = {}, []
    for text in items.column("text").to_pylist():
        counted.append(sorted((known.setdefault(w.encode(), len(known)), n) for w, n in Counter(terms(text)).items()))
    batch = pa.RecordBatch.from_arrays([docs.column("doc_id").combine_chunks(), pa.array([(t or "").encode() for t in docs.column("text").to_pylist()])], ["id", "text"])
    table = pa.Table.from_batches(list(L._count(known)(iter([batch]))))
    flat = [x for c in counted for x in c]
    counts = L.Sparse(np.concatenate([[0], np.cumsum([len(c) for c in counted])]), np.array([t for t, _ in flat]), np.array([n for _, n in flat]))
    lengths = table.column("n").to_pylist()
    df = np.bincount(np.concatenate([c.flatten() for c in table.column("term").chunks]), minlength=len(known))
    weights = np.array([math.floor(1000 * math.log((2 * len(lengths) + 2) / (2 * x + 1))) for x in df])
    best, scored = L.search_table(table, L.Items(list(range(len(counted))), counts, weights, len(lengths), sum(lengths)), 5, [0] * len(counted))
    assert scored < 0.9 * len(lengths) * len(counted)
