"""Joins of sides that both repeat their keys: same rows, dealt over tasks."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from featuremill.operators import joins as J


def sides(spark):
    left = spark.range(3000).select(F.col("id").alias("a"), F.when(F.col("id") % 7 < 3, 1).when(F.col("id") % 7 < 5, F.lit(None)).otherwise(F.col("id") % 40).cast("int").alias("k"))
    right = spark.range(300).select(F.when(F.col("id") % 3 < 1, 1).when(F.col("id") % 3 < 2, F.lit(None)).otherwise(F.col("id") % 50).cast("int").alias("k"), F.col("id").alias("b"))
    return left.unionByName(left.limit(5)), right.unionByName(right.limit(5))


def plain(left, right, how):
    l, r = [tuple(x) for x in left.collect()], [tuple(x) for x in right.collect()]
    by = {}
    for k, b in r:
        by.setdefault(k, []).append(b)
    keys = {k for _, k in l}
    out = [(a, k, b) for a, k in l for b in by.get(k, [] if how == "inner" else [None])]
    return Counter(out + [(None, k, b) for k, b in r if how == "full" and k not in keys])


@pytest.mark.parametrize("how", ["inner", "left", "full"])
@pytest.mark.parametrize("share", [1 << 20, 1000, 1])
def test_dealt_joins_equal_the_plain_join(spark, monkeypatch, how, share):
    left, right = sides(spark)
    monkeypatch.setattr(J.dealt_join, "__defaults__", ("inner", share))
    got = J.null_safe_join(left, right, ["k"], how, dealt=True)
    assert got.columns == ["a", "k", "b"] and Counter(map(tuple, got.collect())) == plain(left, right, how)


def test_a_hot_key_is_many_tasks(spark):
    """Two keys give nearly all rows; no task has as much as one of them."""
    left, right = sides(spark)
    got = J.dealt_join(left, right, ["k"], "inner", 1000).groupBy(F.spark_partition_id()).count().agg({"count": "max"}).first()[0]
    total = J.null_safe_join(left, right, ["k"]).count()
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert got < 2 * total / spread


def test_full_joins_hold_no_key_in_memory(spark):
    """A full outer sort-merge join keeps all rows that a key gives; it is made of a left join and an anti join."""
    left, right = sides(spark)
    plan = J.null_safe_join(left, right, ["k"], "full")._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan and "LeftOuter" in plan and "LeftAnti" in plan
