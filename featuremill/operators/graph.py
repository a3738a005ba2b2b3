"""Weighted undirected graphs as edge tables, Markov clustering, and tables around the clusters."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_phrases
from ..session import cut_lineage, release
from .aggregate import share_of_total, text_list, with_group_stats
from .joins import first_per_key, full_join, null_safe_join

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def map_to_vertices(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """items(alias) to one vertex each, the smallest id; unmapped items are dropped."""
    return items.join(first_per_key(aliases.select("alias", "vertex"), ["alias"], ["vertex"]), "alias")


def induced_edges(edges: DataFrame, vertices: DataFrame, min_score: float = 400) -> DataFrame:
    """Edges at or above the score with both ends among the vertices. The score filter reaches the scan."""
    v = vertices.select("vertex").distinct()
    return (
        edges.filter(F.col("score") >= min_score)
        .join(v.withColumnRenamed("vertex", "src"), "src", "left_semi")
        .join(v.withColumnRenamed("vertex", "dst"), "dst", "left_semi")
    )


def simplify_graph(edges: DataFrame) -> DataFrame:
    """Undirected edges (a < b) without loops; parallel edges become one with the mean score."""
    return (
        edges.filter(F.col("src") != F.col("dst"))
        .groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .agg(F.avg("score").alias("weight"))
    )


def stochastic_matrix(edges: DataFrame, weighted: bool = False) -> DataFrame:
    """Column-stochastic matrix (i, j, v) of an undirected graph with self-loops of weight one."""
    w = F.col("weight").cast("double") if weighted else F.lit(1.0)
    both = F.array(
        F.struct(F.col("a").alias("i"), F.col("b").alias("j"), w.alias("v")),
        F.struct(F.col("b").alias("i"), F.col("a").alias("j"), w.alias("v")),
    )
    arcs = edges.select(F.inline(both))
    loops = arcs.select("j").distinct().select(F.col("j").alias("i"), "j", F.lit(1.0).alias("v"))
    cells = arcs.unionByName(loops)
    return with_group_stats(cells, ["j"], __s=F.sum("v")).select("i", "j", (F.col("v") / F.col("__s")).alias("v"))


#: Entries of a row or column of the matrix beyond which its products are dealt by blocks, products of one share of a column, of the columns that a task
#: has at a time, and of those that it adds up at a time.
HUB, SHARE, LOAD, STEP = 512, 1 << 20, 1 << 23, 1 << 20


def _dealt(matrix: DataFrame, hub: int, share: int, load: int = LOAD) -> DataFrame:
    """(block, s, xi, xv, yj, yv, shares): the factors of the square. Each (i, v) of a record meets each (j, v, shares), where i falls into share s of column j.

    Cell (i, j) adds x(i, m) y(m, j) over m. Neighbouring columns j that get about ``load`` products are a block, and a record has the part of row m that
    is in one block, beside column m. Where column m or row m is long, it is cut into parts of about ``hub`` entries and every part meets every other, so a hub's
    products are dealt over many keys. A column that gets more than ``share`` products is cut into shares by i.
    """
    from .ordered import running_sum

    sides = matrix.select(F.col("j").alias("m"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(matrix.select(F.col("i").alias("m"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    sizes = cut_lineage(sides.groupBy("m").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    parts = lambda c: F.ceil(F.col(c) / hub).cast("int")
    hubs = cut_lineage(sizes.filter((F.col("a") > hub) | (F.col("b") > hub)).select("m", parts("a").alias("na"), parts("b").alias("nb")))
    given = matrix.select(F.col("i").alias("m"), "j").join(sizes, "m").groupBy("j").agg(F.sum("a").alias("n"))
    given = cut_lineage(given.select("j", F.least("n", F.lit(share)).alias("n"), F.greatest(F.lit(1), F.ceil(F.col("n") / share)).cast("int").alias("shares")))
    blocks = running_sum(given, [], ["j"], {"upto": "n"}).select("j", "shares", F.floor((F.col("upto") - F.col("n")) / load).alias("block"))

    one = F.lit(1)
    own = lambda c, n: F.pmod(F.xxhash64(c), F.coalesce(n, one)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, one) - 1))
    cut = not hubs.isEmpty()
    left = matrix.select("i", F.col("j").alias("m"), "v")
    left = left.join(hubs, "m", "left").withColumn("ka", own("i", F.col("na"))) if cut else left
    left = left.groupBy("m", *(["ka", "nb"] if cut else [])).agg(F.collect_list(F.struct("i", "v")).alias("x"))
    left = left.select("m", *(["ka", every(F.col("nb")).alias("kb")] if cut else []), F.col("x.i").alias("xi"), F.col("x.v").alias("xv"))
    right = matrix.select(F.col("i").alias("m"), "j", "v").join(blocks, "j")
    right = right.join(hubs, "m", "left").withColumn("kb", own("j", F.col("nb"))) if cut else right.repartition("m")
    right = right.withColumn("s", every(F.col("shares"))).groupBy("m", "block", "s", *(["kb", "na"] if cut else [])).agg(F.collect_list(F.struct("j", "v", "shares")).alias("y"))
    right = right.select("m", "block", "s", *(["kb", every(F.col("na")).alias("ka")] if cut else []), F.col("y.j").alias("yj"), F.col("y.v").alias("yv"), F.col("y.shares").alias("shares"))
    return left.join(right.hint("merge"), ["m", "ka", "kb"] if cut else ["m"]).select("block", "s", "xi", "xv", "yj", "yv", "shares")


def _products(matrix: DataFrame, hub: int, share: int) -> DataFrame:
    """(j, s, i, p): the products that add up to the square, one by one, with the share s of column j that i falls into."""
    sides = _dealt(matrix, hub, share).select("s", F.explode(F.arrays_zip("yj", "yv", "shares")).alias("y"), F.arrays_zip("xi", "xv").alias("x")).select("s", "y", F.explode("x").alias("x"))
    mine = sides.filter(F.pmod(F.xxhash64("x.xi"), F.col("y.shares")) == F.col("s"))
    return mine.select(F.col("y.yj").alias("j"), "s", F.col("x.xi").alias("i"), (F.col("x.xv") * F.col("y.yv")).alias("p"))


def _lists(table: pa.Table, *names: str) -> tuple[np.ndarray, list[pa.Array]]:
    """Lengths of the lists, and the entries of each column, one after the other."""
    lists = [table.column(c).combine_chunks() for c in names]
    lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
    return np.diff(lists[0].offsets.to_numpy()), [x.flatten() for x in lists]


def _expand(inflation: float, prune: float, step: int = STEP):
    """Inflated cells of one block's columns, without those that are small against their share of the column."""

    def run(key: tuple, records: pa.Table) -> pa.Table:
        s = key[1].as_py()
        xn, (xi, xv) = _lists(records, "xi", "xv")
        yn, (yj, yv, shares) = _lists(records, "yj", "yv", "shares")
        rows, cols = xi.dictionary_encode(), yj.dictionary_encode()
        xi, xv = rows.indices.to_numpy(), xv.to_numpy()
        order = np.argsort(yj := cols.indices.to_numpy().astype(np.int64), kind="stable")
        yj, yv, shares, at = yj[order], yv.to_numpy()[order], shares.to_numpy()[order], np.repeat(np.arange(len(yn)), yn)[order]
        begin, n, side = (np.cumsum(xn) - xn)[at], xn[at].astype(np.int64), max(1, len(rows.dictionary))
        place = pd.util.hash_array(np.asarray(rows.dictionary.to_pandas()), categorize=False) if (shares > 1).any() else None
        # Runs of whole columns with about ``step`` products, and of so few columns that a table of their cells is no larger than eight steps.
        first = np.flatnonzero(np.r_[True, yj[1:] != yj[:-1]]) if len(yj) else np.zeros(0, np.int64)
        upto = np.r_[0, np.cumsum(n)]
        out, c, wide = [], 0, max(1, 8 * step // side)
        while c < len(first):
            e = int(np.searchsorted(upto[first], upto[first[c]] + step, "right")) - 1
            e = min(max(e, c + 1), len(first))
            dense = (e - c) * side <= 16 * (upto[first[e] if e < len(first) else len(yj)] - upto[first[c]]) + side
            if dense:
                e = min(e, c + wide)
            lo, hi = first[c], first[e] if e < len(first) else len(yj)
            many = n[lo:hi]
            took = np.repeat(begin[lo:hi] - (upto[lo:hi] - upto[lo]), many) + np.arange(many.sum())
            cell, p = np.repeat((yj[lo:hi] - yj[lo]) * side, many) + xi[took], np.repeat(yv[lo:hi], many) * xv[took]
            if place is not None and (shares[lo:hi] > 1).any():
                mine = place[xi[took]] % np.repeat(shares[lo:hi], many).astype(np.uint64) == s
                cell, p = cell[mine], p[mine]
            if dense:
                sums = np.bincount(cell, p, minlength=0)
                seen = np.flatnonzero(sums)
                v = sums[seen] ** inflation
            else:
                seen, of = np.unique(cell, return_inverse=True)
                v = np.bincount(of, p, minlength=len(seen)) ** inflation
            if len(seen):
                j = seen // side
                starts = np.flatnonzero(np.r_[True, j[1:] != j[:-1]])
                many = np.diff(np.r_[starts, len(j)])
                total, top = np.repeat(np.add.reduceat(v, starts), many), np.repeat(np.maximum.reduceat(v, starts), many)
                keep = (v >= prune * total) | (v >= (1 - 1e-9) * top)
                out.append((seen[keep] % side, j[keep] + yj[lo], v[keep], total[keep], top[keep]))
            c = e
        i, j, v, total, top = (np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 3
        named = [rows.dictionary.take(pa.array(i)), cols.dictionary.take(pa.array(j))]
        return pa.table([*named, pa.array(np.full(len(i), s, np.int32)), pa.array(v), pa.array(total), pa.array(top)], names=["i", "j", "s", "v", "sum", "top"])

    return run


def markov_round(matrix: DataFrame, inflation: float = 2.5, prune: float = 1e-4, hub: int = HUB, share: int = SHARE) -> DataFrame:
    """Expand (square), inflate (power, then rescale columns), prune small entries and rescale.

    A column's largest entry always stays (ties within 1e-9 too), so no vertex can vanish. After pruning a column holds at
    most 1 / ``prune`` other entries, which bounds the next expansion to that many products per entry.

    Products are made and added up in the task that has a block of columns, and the square is never stored: a task that has a share of a column drops what is small
    against the sum of that share alone, which only falls further behind the whole column's sum. What is left is stored with the sums of the shares, and then cut by
    the whole column.
    """
    kind = dict(matrix.dtypes)
    tasks = _dealt(matrix, hub, share).groupBy("block", "s")
    local = cut_lineage(tasks.applyInArrow(_expand(inflation, prune), f"i {kind['i']}, j {kind['j']}, s int, v double, sum double, top double"))
    big = lambda total, top: (F.col("v") >= prune * F.col(total)) | (F.col("v") >= (1 - 1e-9) * F.col(top))
    totals = local.groupBy("j", "s").agg(F.max("sum").alias("sum"), F.max("top").alias("top")).groupBy("j").agg(F.sum("sum").alias("__s"), F.max("top").alias("__top"))
    kept = local.select("i", "j", "v").join(totals, "j").filter(big("__s", "__top")).select("i", "j", "v")
    return with_group_stats(kept, ["j"], __s=F.sum("v")).select("i", "j", (F.col("v") / F.col("__s")).alias("v"))


def clusters_of(matrix: DataFrame, digits: int = 9) -> DataFrame:
    """Cluster of each vertex: the row that holds most of its column, ties to the smallest vertex."""
    best = matrix.groupBy(F.col("j").alias("vertex")).agg(
        F.min_by("i", F.struct(-F.round("v", digits), F.col("i"))).alias("cluster")
    )
    return best


def markov_cluster(
    edges: DataFrame,
    inflation: float = 2.5,
    prune: float = 1e-4,
    max_rounds: int = 100,
    tolerance: float = 1e-3,
    weighted: bool = False,
) -> DataFrame:
    """(vertex, cluster) after rounds of expansion and inflation.

    Stops when every column is nearly even over its entries (largest entry minus sum of squares
    below the tolerance); fails when ``max_rounds`` do not get there. Each round ends in a reliable checkpoint, so a lost executor repeats one
    round at most; one number per round reaches the driver.
    """
    matrix = cut_lineage(stochastic_matrix(edges, weighted))
    for _ in range(max_rounds):
        before, matrix = matrix, cut_lineage(markov_round(matrix, inflation, prune))
        release(before)
        uneven = matrix.groupBy("j").agg((F.max("v") - F.sum(F.col("v") * F.col("v"))).alias("d")).agg(F.max("d")).first()[0]
        if uneven is None or uneven < tolerance:
            return clusters_of(matrix)
    raise ValueError(f"no stable clusters after {max_rounds} rounds")


def number_clusters(assigned: DataFrame) -> DataFrame:
    """Clusters numbered from 1 by falling size (ties: smallest label), as (vertex, cluster)."""
    from .ordered import row_rank

    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    numbered = row_rank(sizes, ["n", "cluster"], "number", descending=["n"]).select("cluster", "number")
    return assigned.join(numbered, "cluster").select("vertex", F.col("number").alias("cluster"))


def node_annotation(nodes: DataFrame, memberships: DataFrame, phrases: list[str], sep: str = ", ") -> DataFrame:
    """Every node with the sorted names of its sets, stock phrases removed from the names."""
    names = memberships.select("node", strip_phrases(F.col("name"), phrases).alias("name"))
    return nodes.join(text_list(names, ["node"], "name", sep, "set_names"), "node", "left")


def hits_in_sets(hits: DataFrame, annotation: DataFrame, sets: DataFrame) -> DataFrame:
    """Hits with their annotation rows and the scores of the sets among the significant ones (else missing)."""
    return hits.join(annotation, "gene", "left").join(sets, "term", "left")


def cluster_annotation(sets: DataFrame, hits: DataFrame, clusters: DataFrame) -> DataFrame:
    """Full joins of hit sets and clusters on the gene, kept where a set is known."""
    return full_join(full_join(hits, clusters, ["gene"]), sets, ["term"])


def cluster_profile(table: DataFrame, sep: str = "\n") -> DataFrame:
    """Per cluster: mean log2 fold change over its genes and the list of its set names.

    Genes without a cluster form a cluster of their own (missing key).
    """
    means = table.select("cluster", "gene", "log2fc").distinct().groupBy("cluster").agg(F.avg("log2fc").alias("mean_log2fc"))
    return null_safe_join(means, text_list(table.filter(F.col("name").isNotNull()), ["cluster"], "name", sep, "set_names"), ["cluster"], "left")


def cluster_counts(clusters: DataFrame, main: int = 1) -> DataFrame:
    """Genes in the main cluster against all others, with shares; a missing cluster counts as other."""
    side = F.when(F.col("cluster") == main, f"cluster {main}").otherwise("other")
    return share_of_total(clusters.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n")), "n")


def hits_per_cluster(hits: DataFrame, min_change: float = 0.0) -> DataFrame:
    return hits.filter(F.abs("log2fc") > min_change).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def master_table(hits: DataFrame, clusters: DataFrame, sets: DataFrame, means: DataFrame) -> DataFrame:
    """Cluster, cluster mean, gene, change, set and condition means in one table."""
    placed = hits.join(clusters, "gene", "left")
    summary = placed.groupBy("cluster").agg(F.avg("log2fc").alias("mean_cluster_log2fc"))
    joined = null_safe_join(placed, summary, ["cluster"])
    return joined.join(sets, "gene", "left").join(means, "gene", "left")


def top_hits_with_sets(hits: DataFrame, sets: DataFrame, clusters: DataFrame, above: float = 4.0, sep: str = "\n") -> DataFrame:
    """Hits beyond the fold change with their set names and cluster."""
    top = hits.filter(F.abs("log2fc") > above)
    names = text_list(sets.join(top.select("gene"), "gene", "left_semi"), ["gene"], "name", sep, "set_names")
    return top.join(names, "gene", "left").join(clusters, "gene", "left")
