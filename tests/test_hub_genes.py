"""Pairs of the sets of hub genes, made block by block."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from featuremill.operators import enrich as E
from featuremill.operators import joins as J


def memberships(seed=2):
    """Gene 0 is in every set, gene 1 in most, the others in a few."""
    rng = np.random.default_rng(seed)
    rows = {(f"t{t:03d}", 0) for t in range(90)} | {(f"t{t:03d}", 1) for t in range(70)}
    rows |= {(f"t{rng.integers(90):03d}", int(rng.integers(2, 60))) for _ in range(400)}
    return sorted(rows)


def plain(rows, least):
    genes, sizes, shared = {}, Counter(t for t, _ in rows), Counter()
    for t, g in rows:
        genes.setdefault(g, []).append(t)
    for sets in genes.values():
        shared.update(itertools.combinations(sorted(sets), 2))
    return {p: (n, n / (sizes[p[0]] + sizes[p[1]] - n)) for p, n in shared.items() if n >= least}


@pytest.mark.parametrize("least", [1, 2, 3])
@pytest.mark.parametrize("hub", [256, 8, 1])
def test_overlaps_equal_the_plain_join(spark, least, hub):
    rows = memberships()
    df = spark.createDataFrame(rows, "term string, gene long")
    got = {(r.a, r.b): (r.shared, pytest.approx(r.jaccard)) for r in E.set_overlaps(df, least, hub).collect()}
    assert got == plain(rows, least)


def test_no_key_holds_a_hub(spark):
    """Pairs come with carried columns on the right side, once each, from cells of bounded size."""
    rows = [("g", i, i * 10) for i in range(100)] + [("h", 1, 10), (None, 1, 1), (None, 2, 2), ("i", None, 5)]
    df = spark.createDataFrame(rows, "gene string, term long, size long")
    got = J.pairs_of_members(df, "gene", "term", ["size"], hub=10)
    assert got.columns == ["gene", "a", "b", "size_a", "size_b"] and got.count() == 100 * 99 // 2
    assert got.filter("a >= b OR size_a <> a * 10 OR size_b <> b * 10 OR gene <> 'g'").count() == 0
    assert got.distinct().count() == got.count()
    assert J.pairs_of_members(df.filter("false"), "gene", "term").count() == 0
    assert got.groupBy(F.lit(1)).count().first()["count"] == 4950
