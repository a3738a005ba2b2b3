"""Missing values, ties, order, reshape and set rules on hand-made rows."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from featuremill.functions import nulls as N
from featuremill.functions import numeric as M
from featuremill.functions import text as T
from featuremill.operators import aggregate as A
from featuremill.operators import joins as J
from featuremill.operators import reshape as R
from featuremill.operators import setops as S


def rows(df):
    return sorted((tuple(x) for x in df.collect()), key=str)


def test_missing_keys_match(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (2, "z")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (3, "r")], "k int, b string")
    assert rows(J.null_safe_join(a, b, ["k"])) == [(1, "x", "p"), (None, "y", "q")]
    assert rows(J.null_safe_join(a, b, ["k"], "full")) == rows(
        spark.createDataFrame([(1, "x", "p"), (None, "y", "q"), (2, "z", None), (3, None, "r")], "k int, a string, b string")
    )
    assert rows(J.keep_in(a, "k", b, "k")) == [(1, "x"), (None, "y")]
    assert rows(J.keep_not_in(a, "k", b, "k")) == [(2, "z")]
    only_known = b.filter("k IS NOT NULL")
    assert rows(J.keep_not_in(a, "k", only_known, "k")) == [(2, "z"), (None, "y")]


def test_first_match_and_unique_guard(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, 9), (1, 3), (1, None), (2, 5)], "k int, v int")
    assert rows(J.first_match_join(a, b, ["k"], ["v"])) == [(1, 3), (2, 5)]
    with pytest.raises(PySparkException):
        J.guard_unique(b, ["k"]).collect()
    assert J.guard_unique(b, ["v"]).count() == 4


def test_strict_aggregate_and_logs(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "g string, v double")
    out = {r.g: r for r in df.groupBy("g").agg(N.strict(F.sum, F.col("v")).alias("s"), F.sum("v").alias("t")).collect()}
    assert out["a"].s is None and out["a"].t == 1.0 and out["b"].s == 2.0
    zero = spark.createDataFrame([(0.0,), (100.0,)], "v double")
    assert zero.agg(F.avg(M.log10_inf(F.col("v")))).first()[0] == -math.inf
    assert zero.select(M.ratio(F.lit(1.0), F.col("v")).alias("x")).first().x is None


def test_text_rules(spark):
    one = spark.createDataFrame([("PC1", "a,b,c", "1234", "x  y")], "p string, t string, n string, w string")
    out = one.select(
        T.pad_single_digit(F.col("p")), T.replace_first(F.col("t"), ",", "."), T.pad_left(F.col("n"), 3),
        T.paste(F.col("p"), F.lit(None).cast("string")), T.strip_phrases(F.lit(" go (x)  now"), ["(x)"]),
    ).first()
    assert tuple(out) == ("PC01", "a.b,c", "1234", "PC1 NA", "go now")


def test_wide_rejects_repeated_cells(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 2)], "k string, n string, v int")
    with pytest.raises(PySparkException):
        R.to_wide(df, ["k"], "n", "v", ["x"]).collect()


def test_split_rejects_wrong_arity(spark):
    df = spark.createDataFrame([("a_b",), ("a_b_c",)], "c string")
    with pytest.raises(PySparkException):
        R.split_column(df, "c", "_", ["l", "r"]).collect()


def test_sets(spark):
    a = spark.createDataFrame([(1,), (None,), (2,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (None,), (3,)], "k int")
    assert rows(S.two_way_difference(a, b, ["k"])) == [(1, "a"), (3, "b")]
    assert S.set_equal(a, a.distinct(), ["k"]).first().equal is True
    ranked = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "g string, rank int")
    assert rows(S.ordered_intersect(ranked, "g", "rank", ranked.limit(0).union(spark.createDataFrame([("x", 0)], "g string, rank int")), "g")) == [("x", 1)]


def test_group_stats_keep_missing_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 5)], "g string, v int")
    assert rows(A.with_group_stats(df, ["g"], s=F.sum("v"))) == rows(
        spark.createDataFrame([(None, 1, 3), (None, 2, 3), ("a", 5, 5)], "g string, v int, s long")
    )
