"""Absent cells, strict aggregates, unlisted levels, hot keys, file checks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from featuremill.functions.tails import erfc_np
from featuremill.operators import composition as K
from featuremill.operators import counts as C
from featuremill.operators import enrich as E
from featuremill.operators import joins as J
from featuremill.operators import markers as M
from featuremill.operators import multiple_testing as MT
from featuremill.operators import ordered as O
from featuremill.operators import reshape as R
from featuremill.operators.aggregate import describe, mean_and_sd
from featuremill.sources import readers, writers

DESIGN = [("s1", "control"), ("s2", "control"), ("s3", "treated"), ("s4", "treated")]


@pytest.fixture(scope="module")
def design(spark):
    return spark.createDataFrame(DESIGN, "sample string, condition string")


def test_absent_cells_enter_feature_stats(spark, design):
    long = spark.createDataFrame([("a", "s1", 4.0), ("a", "s3", 8.0), ("b", "s1", 1.0), ("b", "s2", 2.0), ("b", "s3", 3.0), ("b", "s4", 6.0)], "feature string, sample string, share double")
    got = {r.feature: r for r in K.feature_stats(long, design).collect()}
    for f, v in {"a": [0, 0, 4, 8], "b": [1, 2, 3, 6]}.items():
        med = float(np.median(v))
        want = (np.mean(v), np.std(v, ddof=1), med, 1.4826 * np.median(np.abs(np.array(v) - med)))
        assert [got[f].mean, got[f].sd, got[f].median, got[f].mad] == pytest.approx(want)


def test_absent_cells_in_markers_and_anchor(spark, design):
    values = spark.createDataFrame([("x", "s1", "control", 6.0), ("y", "s1", "control", 2.0), *[("z", s, c, 5.0 + i) for i, (s, c) in enumerate(DESIGN)]], "symbol string, sample string, condition string, tpm double")
    markers = spark.createDataFrame([("k", "x"), ("k", "y")], "category string, symbol string")
    assert {r.mean_category_tpm for r in M.category_expression(markers, values, design).collect()} == {1.0}
    low = lambda a: spark.range(1).select(M.anchor_minimum(values, a, design).alias("m")).first().m
    assert low("x") == 0.0 and low("z") == 5.0
    assert spark.range(1).select(M.complete_symbol(values, design).alias("m")).first().m == "z"
    means = {r.symbol: r.mean_tpm for r in M.group_means(values, "control", design).collect()}
    assert means == {"x": 3.0, "y": 1.0, "z": 5.5}


def test_combined_table_has_every_cell(spark, design):
    tests = spark.createDataFrame([("a", 0.1), ("none", 0.2)], "feature string, padj double")
    counts = spark.createDataFrame([("a", "s1", 3.0)], "feature string, sample string, count double")
    out = C.combine_results(tests, counts, counts.select("feature", "sample", F.col("count").alias("x")), design, {"x": -1.0}).collect()
    assert len(out) == 8 and sum(r["count"] for r in out) == 3.0 and sorted(r.x for r in out) == [-1.0] * 7 + [3.0]


def test_levels_that_are_not_stated_fail(spark):
    df = spark.createDataFrame([("k", "a", 1.0), ("k", "b", 2.0)], "k string, n string, v double")
    with pytest.raises(Exception, match="not among the levels"):
        R.to_wide(df, ["k"], "n", "v", ["a"]).collect()
    assert R.to_wide(df, ["k"], "n", "v", ["a", "b", "c"], fill=0.0).first().asDict() == {"k": "k", "a": 1.0, "b": 2.0, "c": 0.0}


def test_missing_values_make_aggregates_missing(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, None), (4.0, 3.0)], "x double, y double")
    strict = {r.variable: r for r in describe(df, ["x", "y"]).collect()}
    assert strict["x"].median == 2.0 and strict["y"].mean is None and strict["y"].median is None
    assert {r.variable: r.mean for r in describe(df, ["x", "y"], na_rm=True).collect()}["y"] == 2.0
    assert mean_and_sd(df, "y").first().mean is None and mean_and_sd(df, "y", na_rm=True).first().mean == 2.0


def test_fold_weights_average_one_over_the_tests(spark):
    rows = [(f"f{i}", (i % 50 + 1) / 51.0 if i % 5 else None, float(i % 97)) for i in range(1500)]
    out = MT.learned_weights(spark.createDataFrame(rows, "feature string, p double, base_mean double"), 4, 3, 0.1)
    for r in out.filter("p IS NOT NULL").groupBy("fold").agg(F.avg("weight").alias("m")).collect():
        assert r.m == pytest.approx(1.0, abs=1e-9)


def test_adjustment_runs_over_all_tested_sets(spark):
    ranks = spark.createDataFrame([(f"g{i}", i + 1) for i in range(200)], "gene string, rank int")
    sets = spark.createDataFrame([("top", list(range(1, 9))), *[(f"r{k}", sorted({(37 * k + 23 * i) % 200 + 1 for i in range(8)})) for k in range(40)]], "term string, ranks array<int>")
    loose, _ = E.overlap_correction(sets, ranks, 0.2, fdr=1.0)
    tight, edges = E.overlap_correction(sets, ranks, 0.2, fdr=1e-6)
    p = {r.term: r.p for r in loose.collect()}
    kept = [r.term for r in tight.filter("kept").collect()]
    assert len(p) > 3 and kept == ["top"] and edges.count() == 0
    top = loose.filter("term = 'top'").first()
    assert top.adjusted_p == pytest.approx(41 * top.corrected_p, rel=1e-9)


@pytest.mark.parametrize("hot", [0, 1])
def test_full_and_open_joins(spark, hot):
    left = spark.createDataFrame([(None if i % 3 == 0 else hot if i % 3 == 1 else i, i) for i in range(60)], "k long, l long")
    right = spark.createDataFrame([(None, -1), (hot, -2), (1000, -3)], "k long, r long")
    key = lambda rows: sorted(map(str, rows))
    assert key(J.full_join(left, right, ["k"]).select("k", "l", "r").collect()) == key(J.null_safe_join(left, right, ["k"], "full").select("k", "l", "r").collect())
    assert key(J.open_left_join(left, right, "k").select("k", "l", "r").collect()) == key(left.join(right, "k", "left").select("k", "l", "r").collect())


def test_rows_without_a_key_are_spread(spark):
    left = spark.range(4000).select(F.when(F.col("id") % 5 == 0, F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("w")).hint("merge")
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        sizes = [r.n for r in J.open_left_join(left, right, "k").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert max(sizes) < 2 * 4000 / 8


def test_ranks_that_do_not_settle_fail(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    with pytest.raises(ValueError, match="still move"):
        E.page_rank(nodes.unionByName(spark.createDataFrame([("c",)], "node string")), edges.unionByName(spark.createDataFrame([("c", "a")], "src string, dst string")), max_rounds=10)
    assert {round(r["rank"], 6) for r in E.page_rank(nodes, edges).collect()} == {0.5}


def test_positions(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "o int, c string")
    b = spark.createDataFrame([(1, "x"), (2, "q")], "o int, c string")
    assert sorted(map(tuple, O.unequal_positions(a, b, "c", ["o"], ["o"]).collect())) == [(2, "y", "q"), (3, "z", None)]
    assert [r.c for r in O.first_rows(a, ["o"], 2).collect()] == ["x", "y"]


def test_headers_are_dropped_by_place(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text("k\tv\nid\tn\n1\t2\nk\tv\n" if name == "a" else "k\tv\nid\tn\n3\t4\n")
    out = readers.read_multi_header(spark, str(tmp_path), 2, "_".join)
    assert sorted(map(tuple, out.collect())) == [("1", "2"), ("3", "4"), ("k", "v")]
    (tmp_path / "c").write_text("k\tw\nid\tn\n5\t6\n")
    with pytest.raises(Exception, match="another header"):
        readers.read_multi_header(spark, str(tmp_path), 2, "_".join).collect()


def test_swapped_header_fails_and_half_written_folder_is_rebuilt(spark, tmp_path):
    (tmp_path / "t").write_text("b\ta\n1\t2\n")
    with pytest.raises(Exception):
        readers.read_tsv(spark, str(tmp_path / "t"), "a int, b int", check_header=True).collect()
    path = str(tmp_path / "half")
    spark.range(3).write.parquet(path)
    (tmp_path / "half" / "_SUCCESS").unlink()
    assert writers.reuse_or_build(lambda: spark.range(5), spark, path).count() == 5
    assert writers.reuse_or_build(None, spark, path).count() == 5


def test_erfc():
    x = np.linspace(0, 26, 500)
    assert np.allclose(erfc_np(x), [math.erfc(v) for v in x], rtol=1e-11, atol=0)
    assert np.isnan(erfc_np([np.nan])[0]) and erfc_np([np.inf])[0] == 0
