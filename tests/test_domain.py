"""Sets, graphs, compositions, markers, annotation and files."""

import gzip
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from featuremill.functions import tails
from featuremill.operators import annotate as A
from featuremill.operators import composition as K
from featuremill.operators import counts as C
from featuremill.operators import enrich as E
from featuremill.operators import graph as G
from featuremill.operators import markers as M
from featuremill.sources import readers as RD
from featuremill.sources import writers as W


def rows(df):
    return sorted((tuple(x) for x in df.collect()), key=str)


# Counts ---------------------------------------------------------------------------------------


def test_tpm_sums_to_a_million(spark):
    counts = spark.createDataFrame([("a", "s", 10.0), ("b", "s", 30.0), ("a", "t", 5.0)], "feature string, sample string, count double")
    lengths = spark.createDataFrame([("a", 500.0), ("b", 1500.0)], "feature string, length double")
    out = C.tpm(counts, lengths)
    assert {r.sample: round(r.t, 6) for r in out.groupBy("sample").agg(F.sum("tpm").alias("t")).collect()} == {"s": 1e6, "t": 1e6}


def test_size_factors_and_rollup(spark):
    counts = spark.createDataFrame(
        [(f, s, float(v * m)) for f, v in (("a", 2), ("b", 8), ("c", 32)) for s, m in (("x", 1), ("y", 4))] + [("z", "x", 5.0)],
        "feature string, sample string, count double",
    )
    samples = spark.createDataFrame([("x",), ("y",)], "sample string")
    out = {r.sample: r.size_factor for r in C.size_factors(counts, samples).collect()}
    assert out == pytest.approx({"x": 0.5, "y": 2.0})
    ids = counts.withColumnRenamed("feature", "id")
    symbols = spark.createDataFrame([("a", "S"), ("b", "S"), ("c", "T"), ("z", "T")], "id string, symbol string")
    merged = {(r.symbol, r.sample): (r.id, r["count"]) for r in C.merge_duplicate_symbols(ids, symbols).collect()}
    assert merged[("S", "x")] == ("a", 10.0) and merged[("T", "x")] == ("c", 37.0)


def test_group_means_count_absent_cells(spark):
    values = spark.createDataFrame([("g", "s1", "c", 10.0), ("g", "s2", "c", 20.0), ("h", "s1", "c", 30.0)], "symbol string, sample string, condition string, tpm double")
    out = {r.symbol: r for r in M.group_means(values, "c").collect()}
    assert out["h"].mean_tpm == 15.0 and out["h"].mean_log10 == float("-inf") and out["g"].mean_tpm == 15.0


# Annotation -----------------------------------------------------------------------------------


def test_reconcile_tiers(spark):
    items = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "C"), ("4", "D"), (None, "E")], "id string, symbol string")
    legend = spark.createDataFrame([("1", "A"), ("1", "A2"), ("2", "X"), ("9", "C"), ("8", "C"), (None, "Q")], "ext_id string, ext_symbol string")
    first = {(r.id, r.symbol): (r.ext_id, r.tier) for r in A.reconcile_ids(items, legend).collect()}
    assert first == {
        ("1", "A"): ("1", A.BOTH), ("2", "B"): ("2", A.ID_ONLY), ("3", "C"): ("8", A.SYMBOL_ONLY), ("4", "D"): ("4", A.NONE), (None, "E"): (None, A.NONE),
    }
    assert A.reconcile_ids(items, legend, False).filter("id = '3'").count() == 2


def test_ranked_list_puts_missing_last(spark):
    tests = spark.createDataFrame([("a", 0.2), ("b", None), ("c", 0.1), ("d", 0.2), ("x", 0.0)], "gene string, padj double")
    ref = spark.createDataFrame([(g,) for g in "abcd"], "gene string")
    assert [r.gene for r in A.ranked_list(tests, ref).orderBy("rank").collect()] == ["c", "a", "d", "b"]


# Sets -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sets():
    rng = random.Random(5)
    out = {f"t{i}": sorted(rng.sample(range(1, 61), rng.randint(3, 12))) for i in range(20)}
    for s in out.values():  # one hub gene in every set
        if 60 not in s:
            s.append(60)
    return out


@pytest.mark.parametrize("least", [1, 2, 3])
def test_overlaps_match_brute_force(spark, sets, least):
    members = spark.createDataFrame([(t, g, len(s)) for t, s in sets.items() for g in s], "term string, gene int, size long")
    got = {(r.a, r.b): r.shared for r in E.set_overlaps(members, least).collect()}
    want = {(a, b): len(set(sets[a]) & set(sets[b])) for a, b in itertools.combinations(sorted(sets), 2)}
    assert got == {k: v for k, v in want.items() if v >= least}


def test_enrichment_and_correction_match_brute_force(spark):
    n, cut = 60, 0.05
    strong = {"a": [1, 2, 3, 4, 5], "b": [1, 2, 3, 4, 40, 50], "c": [6, 7, 8, 30], "d": [20, 40, 59]}
    ranks = spark.createDataFrame([(i, i) for i in range(1, n + 1)], "gene long, rank long")
    members = spark.createDataFrame([(t, g, len(s)) for t, s in strong.items() for g in s], "term string, gene long, size long")

    def p(s):
        return min((tails.hypergeom_upper_np([n], [len(s)], [r], [k])[0] for k, r in enumerate(sorted(s), 1)), default=1.0)

    rs = E.ranked_sets(members, ranks)
    got = {r.term: r.p for r in E.ranked_enrichment(rs, ranks).collect()}
    assert got == pytest.approx({t: p(s) for t, s in strong.items()})
    table, edges = E.overlap_correction(rs, ranks, cut, fdr=1.0)
    sig = {t: set(s) for t, s in strong.items() if p(s) <= cut}
    worst, dropped = {t: p(s) for t, s in sig.items()}, set()
    for a, b in itertools.permutations(sig, 2):
        if sig[a] & sig[b]:
            qa, qb = p(sig[a] - sig[b]), p(sig[b] - sig[a])
            worst[a] = max(worst[a], qa)
            if qa > cut >= qb:
                dropped.add(a)
    out = {r.term: (r.corrected_p, r.kept) for r in table.collect()}
    assert {t: v[1] for t, v in out.items()} == {t: t not in dropped for t in sig}
    assert {t: v[0] for t, v in out.items()} == pytest.approx(worst)
    assert all({r.src, r.dst} <= set(sig) - dropped for r in edges.collect())


def test_page_rank_matches_dense_solution(spark):
    links = [("a", "b"), ("a", "c"), ("b", "c"), ("d", "c"), ("c", "a")]
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    got = {r.node: r["rank"] for r in E.page_rank(nodes, spark.createDataFrame(links, "src string, dst string")).collect()}
    ix = {x: i for i, x in enumerate("abcde")}
    m = np.zeros((5, 5))
    for s, d in links:
        m[ix[d], ix[s]] = 1 / sum(1 for l in links if l[0] == s)
    for j in range(5):
        if m[:, j].sum() == 0:
            m[:, j] = 1 / 5
    v = np.full(5, 0.2)
    for _ in range(200):
        v = 0.15 / 5 + 0.85 * m @ v
    assert sum(got.values()) == pytest.approx(1.0)
    assert [got[x] for x in "abcde"] == pytest.approx(list(v), abs=1e-4)


def test_set_rank_is_reproducible(spark):
    table = spark.createDataFrame([(t, 3, 0.001 * (i + 1), 0.002 * (i + 1), True) for i, t in enumerate("abcd")], "term string, size int, p double, corrected_p double, kept boolean")
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "b")], "src string, dst string")
    one, two = (rows(E.set_rank(table, edges, 20)) for _ in range(2))
    assert one == two and len(one) == 4
    best = {r.term: r for r in E.set_rank(table, edges, 20).collect()}
    assert best["b"].set_rank == max(r.set_rank for r in best.values()) and 0 < best["b"].p_set_rank <= 1


# Graph ----------------------------------------------------------------------------------------


def test_markov_cluster_splits_cliques(spark):
    left = list(itertools.combinations(range(5), 2))
    right = list(itertools.combinations(range(10, 15), 2))
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in left + right + [(4, 10)]], "a long, b long, weight double")
    m = G.stochastic_matrix(edges)
    assert all(r.s == pytest.approx(1.0) for r in m.groupBy("j").agg(F.sum("v").alias("s")).collect())
    after = G.markov_round(m)
    assert all(r.s == pytest.approx(1.0) for r in after.groupBy("j").agg(F.sum("v").alias("s")).collect())
    numbered = {r.vertex: r.cluster for r in G.number_clusters(G.markov_cluster(edges)).collect()}
    assert len({numbered[v] for v in range(5)}) == 1 and len({numbered[v] for v in range(10, 15)}) == 1
    assert numbered[0] != numbered[14] and set(numbered.values()) == {1, 2}


def test_simplify(spark):
    e = spark.createDataFrame([(1, 2, 400.0), (2, 1, 600.0), (3, 3, 900.0)], "src int, dst int, score double")
    assert rows(G.simplify_graph(e)) == [(1, 2, 500.0)]


# Composition ----------------------------------------------------------------------------------


def test_terminal_fragments():
    out = K.terminal_fragments("Fuc(a1-2)Gal(b1-3)[Neu5Ac(a2-6)]GalNAc")
    assert sorted(out) == sorted(
        ["Terminal_Fuc(a1-2)", "Terminal_Fuc(a1-2)Gal(b1-3)", "Terminal_Fuc(a1-2)Gal(b1-3)GalNAc", "Terminal_Neu5Ac(a2-6)", "Terminal_Neu5Ac(a2-6)GalNAc"]
    )
    nested = K.terminal_fragments("Fuc(a1-2)[GalNAc(a1-3)]Gal(b1-3)[Gal(b1-4)GlcNAc(b1-6)]GalNAc")
    assert "Terminal_GalNAc(a1-3)Gal(b1-3)GalNAc" in nested and "Terminal_Gal(b1-4)GlcNAc(b1-6)GalNAc" in nested
    assert K.terminal_fragments("") == [] and K.terminal_fragments("GalNAc") == ["Terminal_GalNAc"]


def test_cleaning_and_encoded_names(spark):
    raw = spark.createDataFrame([("7", "1,5*", "ND"), ("1234", "2.5", "NA"), ("12", None, "3")], "id string, rt string, ab string")
    out = {r.id: (r.rt, r.ab, r.comment) for r in K.clean_measurements(raw, ["rt", "ab"], "rt", "note", "id").collect()}
    assert out == {"007": (1.5, 0.0, "note"), "1234": (2.5, 0.0, None), "012": (None, 3.0, None)}
    wide = spark.createDataFrame([(1, 2.0, 3.0, 4.0, 5.0)], "id int, M_s1_A_RT double, M_s1_A_AB double, M_s2_B_RT double, M_s2_B_AB double")
    long = K.parse_encoded_columns(wide, ["id"], ["file", "sample", "grp", "variable"], {"RT": "rt", "AB": "ab"}, "M_")
    assert rows(long) == [(1, "M", "s1", "A", 2.0, 3.0), (1, "M", "s2", "B", 4.0, 5.0)]


def test_shares_and_rest_conserve_totals(spark):
    long = spark.createDataFrame([(f, s, float(f * 3 + i + 1)) for f in range(6) for i, s in enumerate("xy")], "feature int, sample string, value double")
    shares = K.relative_abundance(long)
    assert all(r.t == pytest.approx(100.0) for r in shares.groupBy("sample").agg(F.sum("share").alias("t")).collect())
    means = shares.groupBy("feature").agg(F.avg("share").alias("mean"))
    r = K.top_vs_rest(means, 2).first()
    assert r.top_sum + r.rest_sum == pytest.approx(100.0)


# Files ----------------------------------------------------------------------------------------


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("Sample ID\tvalue\ns1\t1.5\n\t\ns2\tx\n")
    out = RD.read_tsv(spark, str(tmp_path / "a.tsv"), "sample string, value double")
    assert rows(out) == [("s1", 1.5), ("s2", None)]
    (tmp_path / "b.tsv").write_text("t1\tg1\nt2\tg1\n")
    assert RD.read_tsv_headerless(spark, str(tmp_path / "b.tsv"), "tx string, gene string").count() == 2
    with gzip.open(tmp_path / "c.txt.gz", "wt") as f:
        f.write("#id\talias\n1\tx\n")
    assert rows(RD.read_tsv(spark, str(tmp_path / "c.txt.gz"), "id int, alias string")) == [(1, "x")]
    (tmp_path / "d.txt").write_text("p1 p2 score\na b 400\n")
    assert rows(RD.read_space_delimited(spark, str(tmp_path / "d.txt"), "p1 string, p2 string, score double")) == [("a", "b", 400.0)]


def test_sample_files_and_headers(spark, tmp_path):
    for s in ("P_1", "P_2"):
        (tmp_path / s).mkdir()
        (tmp_path / s / "quant.sf").write_text(f"Name\tReads\ntx\t{s[-1]}\n")
    out = RD.read_sample_files(spark, f"{tmp_path}/*/quant.sf", "name string, reads double", r"/(P_\d+)/quant")
    assert rows(out) == [("P_1", "tx", 1.0), ("P_2", "tx", 2.0)]
    (tmp_path / "m.tsv").write_text("\tf1\tf1\n\ts a\ts a\nid\tRT\tInt\ng1\t1\tND\ng2\t2\t3\n\t\t\n")
    name = lambda c: c[2] if not c[0] else "-".join(c).replace(" ", "_")
    multi = RD.read_multi_header(spark, str(tmp_path / "m.tsv"), 3, name, {"f1-s_a-RT": "double"})
    assert multi.columns == ["id", "f1-s_a-RT", "f1-s_a-Int"] and rows(multi) == [("g1", 1.0, "ND"), ("g2", 2.0, "3")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    W.write_tsv(df, str(tmp_path / "out"))
    assert rows(RD.read_tsv(spark, str(tmp_path / "out"), "k int, v string")) == rows(df)
    W.write_csv(df, str(tmp_path / "out_csv"))
    W.write_table(df, str(tmp_path / "out_pq"))
    assert rows(RD.read_bridge(spark, str(tmp_path / "out_pq"), "k")) == [(1,), (2,)]
    calls = []
    build = lambda: calls.append(1) or df
    for _ in range(2):
        assert W.reuse_or_build(build, spark, str(tmp_path / "mid")).count() == 2
    assert calls == [1]
    assert rows(RD.literal_list(spark, ["x", "y"])) == [("x", 1), ("y", 2)]
