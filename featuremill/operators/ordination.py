"""Principal components, distances and neighbours of samples and of points.

With few columns, what is computed over features is the column x column product matrix: each task adds up the products of its own
features and emits one partial matrix. Beyond MAX_SIDE columns there is no such matrix in any task: distances come from products of
pairs of column tiles, components from a block iteration that only multiplies by tall blocks.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import row_rank
from .vectors import feature_vectors, sample_order

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Columns up to which a task may hold a whole matrix, and columns of a tile beyond.
MAX_SIDE, TILE = 4096, 1024


def _products(column: str, center: bool, scale: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf[column].to_numpy()).astype(float)
            if x.shape[1] > MAX_SIDE:
                raise ValueError(f"more than {MAX_SIDE} columns in one matrix")
            if center:
                x = x - x.mean(axis=1, keepdims=True)
            if scale:
                sd = x.std(axis=1, ddof=1, keepdims=True)
                x = np.divide(x, sd, out=np.zeros_like(x), where=sd > 0)
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pd.DataFrame({"i": i, "j": j, "value": total[i, j]})

    return run


def product_matrix(vectors: DataFrame, column: str, center: bool = False, scale: bool = False) -> DataFrame:
    """Sum over rows of the outer product of ``column`` with itself, as (i, j, value) with i <= j; at most MAX_SIDE columns."""
    return (
        vectors.select(column)
        .mapInPandas(_products(column, center, scale), "i int, j int, value double")
        .groupBy("i", "j")
        .agg(F.sum("value").alias("value"))
    )


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _tile_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of two tiles, added up over runs of equal (a, b, g): a row for each column of the first tile."""

    def out(key: tuple, total: np.ndarray) -> pa.RecordBatch:
        n = len(total)
        same = [pa.array([x] * n, pa.int32()) for x in key[:2]]
        return pa.RecordBatch.from_arrays([*same, pa.array(np.arange(n, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["a", "b", "r", "cells"])

    key, total = None, None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for s, e in zip(cuts[:-1], cuts[1:]):
            if s == e:
                continue
            here = tuple(keys[s].tolist())
            if here != key:
                if key is not None:
                    yield out(key, total)
                key, total = here, 0.0
            total = total + _matrix(batch.column(3).slice(s, e - s)).T @ _matrix(batch.column(4).slice(s, e - s))
    if key is not None:
        yield out(key, total)


def product_tiles(vectors: DataFrame, column: str, side: int, tile: int = TILE, groups: int = 8) -> DataFrame:
    """(i, j, value) with i <= j, as :func:`product_matrix` gives, for any number of columns.

    Columns are cut into tiles. A task has a pair of tiles and a share (``groups``) of the rows, streams their two parts of each row, and
    holds one tile x tile matrix; the shares are added up afterwards. A row's cells travel once for each tile.
    """
    n = math.ceil(side / tile)
    part = lambda k: F.slice(F.col(column), k * tile + 1, F.lit(tile))
    firsts = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("a")
    dealt = vectors.select(F.pmod(F.xxhash64(column), F.lit(groups)).cast("int").alias("g"), F.col(column), firsts)
    dealt = dealt.select("a", "g", column, F.explode(F.sequence(F.col("a"), F.lit(n - 1))).alias("b"))
    rows = dealt.select("a", "b", "g", part(F.col("a")).alias("x"), part(F.col("b")).alias("y")).repartition("a", "b", "g").sortWithinPartitions("a", "b", "g")
    sums = rows.mapInArrow(_tile_products, "a int, b int, r int, cells array<double>")
    cells = sums.select((F.col("a") * tile + F.col("r")).alias("i"), F.col("b") * tile, F.posexplode("cells").alias("c", "value"))
    cells = cells.select("i", (F.col(cells.columns[1]) + F.col("c")).alias("j"), "value").filter("i <= j")
    return cells.groupBy("i", "j").agg(F.sum("value").alias("value"))


def _components(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["i"].max()) + 1
        m = np.zeros((n, n))
        m[pdf["i"], pdf["j"]] = pdf["value"]
        values, vectors = np.linalg.eigh(np.triu(m) + np.triu(m, 1).T)
        order = np.argsort(values)[::-1][:k]
        lam = np.maximum(values[order], 0.0)
        v = vectors[:, order]
        # Sign rule: the entry of largest size is positive.
        v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
        all_var = np.maximum(values, 0.0).sum()
        return pd.DataFrame(
            {
                "component": np.repeat(np.arange(1, len(order) + 1), n),
                "i": np.tile(np.arange(n), len(order)),
                "vector": v.T.ravel(),
                "eigenvalue": np.repeat(lam, n),
                "total": all_var,
            }
        )

    return run


def eigen(matrix: DataFrame, k: int) -> DataFrame:
    """Leading eigenvectors of a bounded (at most 4096 x 4096) symmetric matrix in (i, j, value) form."""
    return matrix.groupBy().applyInPandas(
        _components(k), "component int, i int, vector double, eigenvalue double, total double"
    )


# Components without a matrix --------------------------------------------------------------------


def _ready(center: bool, scale: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0))
            if x.size and center:
                x = x - x.mean(axis=1, keepdims=True)
            if x.size and scale:
                sd = x.std(axis=1, ddof=1, keepdims=True)
                x = np.divide(x, sd, out=np.zeros_like(x), where=sd > 0)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), pa.array((x**2).sum(axis=1) if x.size else [], pa.float64())], ["x", "norm"])

    return run


def _apply(block: np.ndarray):
    """This task's part of X'X block: a row for each column, with as many sums as the block is wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch.column(0))
            if x.size:
                y = x.T @ (x @ block)
                total = y if total is None else total + y
        if total is not None:
            for s in range(0, len(total), 4096):
                part = total[s : s + 4096]
                arrays = [pa.array(np.arange(s, s + len(part), dtype=np.int32)), *[pa.array(np.ascontiguousarray(part[:, c])) for c in range(part.shape[1])]]
                yield pa.RecordBatch.from_arrays(arrays, ["i", *[f"y{c}" for c in range(part.shape[1])]])

    return run


def block_eigen(apply: Callable[[np.ndarray], np.ndarray], side: int, k: int, tolerance: float = 1e-9, keep: int = 12, max_rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues and vectors of a symmetric matrix known only by its products with blocks of k columns.

    Each round multiplies one new block, solves the small problem on all blocks held, and takes what is left over of the k vectors as
    the next block. ``keep`` blocks are held at most; then the best two blocks' worth of vectors start anew. Fails if the residuals do not fall
    below ``tolerance`` of the largest value in ``max_rounds``.
    """
    k = min(k, side)
    new = np.linalg.qr(np.random.default_rng(7).normal(size=(side, k)))[0]
    basis, image = np.zeros((side, 0)), np.zeros((side, 0))
    for _ in range(max_rounds):
        basis, image = np.hstack([basis, new]), np.hstack([image, apply(new)])
        small = basis.T @ image
        values, w = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)
        values, w = values[order], w[:, order]
        u, au = basis @ w[:, :k], image @ w[:, :k]
        rest = au - u * values[:k]
        left = np.linalg.norm(rest, axis=0)
        if left.max() <= tolerance * max(values[0], 1e-300) or basis.shape[1] >= side:
            return values[:k], u
        if basis.shape[1] >= keep * k:
            basis, image = basis @ w[:, : 2 * k], image @ w[:, : 2 * k]
        # Vectors that have settled leave only rounding, which is no direction to go on in.
        new = rest[:, left > tolerance / 10 * values[0]] / left[left > tolerance / 10 * values[0]]
        for _ in range(3):
            new = np.linalg.qr(new - basis @ (basis.T @ new))[0]
        new = new[:, : side - basis.shape[1]]
    raise ValueError(f"components do not settle in {max_rounds} rounds")


def iterated_components(vectors: DataFrame, column: str, k: int, side: int, center: bool = True, scale: bool = False) -> DataFrame:
    """(component, i, vector, eigenvalue, total) as :func:`eigen` gives, without a side x side matrix.

    The driver and each task hold blocks of k columns of length ``side``: as much as a few rows of the input. A round is one pass
    over the stored rows.
    """
    spark = vectors.sparkSession
    ready = cut_lineage(vectors.select(F.col(column).cast("array<double>")).mapInArrow(_ready(center, scale), "x array<double>, norm double"))
    total = ready.agg(F.sum("norm")).first()[0] or 0.0

    def apply(block: np.ndarray) -> np.ndarray:
        width = block.shape[1]
        names = [f"y{c}" for c in range(width)]
        sums = ready.select("x").mapInArrow(_apply(block), "i int, " + ", ".join(f"{c} double" for c in names)).groupBy("i").agg(*[F.sum(c).alias(c) for c in names])
        got = sums.toPandas()
        out = np.zeros((side, width))
        out[got["i"].to_numpy()] = got[names].to_numpy()
        return out

    values, v = block_eigen(apply, side, k)
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    n = len(values)
    table = pd.DataFrame({
        "component": np.repeat(np.arange(1, n + 1), side).astype(np.int32), "i": np.tile(np.arange(side), n).astype(np.int32), "vector": v.T.ravel(),
        "eigenvalue": np.repeat(np.maximum(values, 0.0), side), "total": float(total),
    })
    return spark.createDataFrame(table, "component int, i int, vector double, eigenvalue double, total double")


def pca_samples(long: DataFrame, samples: DataFrame, value: str, k: int = 5, scale: bool = False, max_side: int = MAX_SIDE) -> DataFrame:
    """Scores of samples when features are the variables: (sample, component, score, proportion).

    Up to ``max_side`` samples by their product matrix, beyond by :func:`iterated_components`.
    """
    vectors, side = feature_vectors(long, samples, value, "x"), samples.select("sample").distinct().count()
    if side <= max_side:
        parts = eigen(product_matrix(vectors, "x", center=True, scale=scale), k)
    else:
        parts = iterated_components(vectors, "x", k, side, True, scale)
    named = parts.withColumn("sample", F.element_at(sample_order(samples), F.col("i") + 1))
    return named.select(
        "sample",
        "component",
        (F.col("vector") * F.sqrt("eigenvalue")).alias("score"),
        F.try_divide(F.col("eigenvalue"), F.col("total")).alias("proportion"),
    )


def pca_points(points: DataFrame, id_col: str, column: str, k: int = 5) -> DataFrame:
    """Scores of many points in few dimensions: (id, scores array); the covariance is dims x dims."""
    dims = F.posexplode(column)
    means = (
        points.select(dims.alias("d", "x"))
        .groupBy("d")
        .agg(F.avg("x").alias("m"))
        .agg(F.sort_array(F.collect_list(F.struct("d", "m"))).alias("s"))
        .select(F.col("s.m").alias("m"))
        .scalar()
    )
    centred = points.withColumn("__m", means).select(id_col, F.zip_with(column, "__m", lambda x, m: x - m).alias("x"))
    loads = (
        eigen(product_matrix(centred, "x"), k)
        .groupBy("component")
        .agg(F.sort_array(F.collect_list(F.struct("i", "vector"))).alias("v"))
        .agg(F.sort_array(F.collect_list(F.struct("component", F.col("v.vector").alias("v")))).alias("l"))
        .select(F.col("l.v").alias("l"))
        .scalar()
    )
    dot = lambda v: F.aggregate(F.zip_with(F.col("x"), v, lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    return centred.withColumn("__l", loads).select(id_col, F.transform("__l", dot).alias("scores"))


def explained_variance(scores: DataFrame) -> DataFrame:
    """Proportion and cumulative proportion per component (as many rows as components)."""
    per = scores.groupBy("component").agg(F.max("proportion").alias("proportion"))
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.withColumn("cumulative", F.sum("proportion").over(w))


def pairwise_distance(long: DataFrame, samples: DataFrame, value: str, max_side: int = MAX_SIDE, tile: int = TILE) -> DataFrame:
    """Euclidean distance of every pair of samples (a < b), read off the products of their columns.

    Features are centred over the samples first, which leaves distances as they are and keeps their digits. Beyond ``max_side`` samples the products
    come from pairs of column tiles.
    """
    vectors, side = feature_vectors(long, samples, value, "x"), samples.select("sample").distinct().count()
    if side <= max_side:
        products = product_matrix(vectors, "x", center=True)
    else:
        mean = F.aggregate("x", F.lit(0.0), lambda s, t: s + t) / F.size("x")
        centred = vectors.withColumn("m", mean).select(F.transform("x", lambda v: v - F.col("m")).alias("x"))
        products = cut_lineage(product_tiles(centred, "x", side, tile))
    norms = products.filter(F.col("i") == F.col("j")).select(F.col("i").alias("n"), F.col("value").alias("norm"))
    order = sample_order(samples)
    pairs = (
        products.filter(F.col("i") < F.col("j"))
        .join(norms.withColumnsRenamed({"n": "i", "norm": "ni"}), "i")
        .join(norms.withColumnsRenamed({"n": "j", "norm": "nj"}), "j")
    )
    d2 = F.greatest(F.col("ni") + F.col("nj") - 2.0 * F.col("value"), F.lit(0.0))
    return pairs.select(
        F.element_at(order, F.col("i") + 1).alias("a"), F.element_at(order, F.col("j") + 1).alias("b"), F.sqrt(d2).alias("distance")
    )


def knn_graph(distances: DataFrame, k: int) -> DataFrame:
    """k nearest neighbours of each sample from the pair distances; ties go to the smaller name."""
    both = distances.select("a", "b", "distance").unionByName(
        distances.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance")
    )
    w = Window.partitionBy("a").orderBy("distance", "b")
    return (
        both.withColumn("nth", F.row_number().over(w))
        .filter(F.col("nth") <= k)
        .select(F.col("a").alias("sample"), F.col("b").alias("neighbour"), "distance", "nth")
    )


# Neighbours of many points -------------------------------------------------------------------

#: Points of one block, what a task compares with another block at a time; most pivots, points they are chosen from, and rings of a cell.
#: Neighbouring blocks that a task compares with as many others.
BLOCK, PIVOTS, PIVOT_SAMPLE, RINGS, GROUP = 1024, 64, 4096, 64, 16


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    return _matrix(pa.concat_arrays(column.chunks)) if column.num_chunks else np.zeros((0, 0))


def _near(ids: np.ndarray, at: np.ndarray, names: np.ndarray, to: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, ...]:
    """k nearest of the points ``to``, whose names go up, for each query: (id, neighbour, distance), ties to the smaller name.

    Products of matrices give squares that are right but for their rounding; whatever may be among the k nearest by them is then measured as it stands.
    """
    out: list[tuple[np.ndarray, ...]] = [(ids[:0], names[:0], np.zeros(0))]
    if not len(names) or not len(ids):
        return out[0]
    squares = (to**2).sum(1)
    step, part = max(1, (1 << 20) // len(names)), max(1, (1 << 20) // max(1, to.shape[1]))
    for s in range(0, len(ids), step):
        x = at[s : s + step]
        own = (x**2).sum(1)
        d = own[:, None] + squares[None, :] - 2.0 * (x @ to.T)
        slack = 1e-14 * (8 + to.shape[1]) * (own + squares.max())
        if same:
            d[ids[s : s + step, None] == names[None, :]] = np.inf
        most = np.partition(d, k - 1, axis=1)[:, k - 1] if k <= len(names) else np.full(len(x), np.inf)
        r, c = np.nonzero((d <= (most + 2 * slack)[:, None]) & (d < np.inf))
        far = np.concatenate([np.zeros(0), *[np.sqrt(((x[r[i : i + part]] - to[c[i : i + part]]) ** 2).sum(axis=1)) for i in range(0, len(r), part)]])
        order = np.lexsort((c, far, r))
        r, c, far = r[order], c[order], far[order]
        first = np.searchsorted(r, r, "left")
        keep = np.arange(len(r)) - first < k
        out.append((ids[s : s + step][r[keep]], names[c[keep]], far[keep]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _found(parts: list[tuple[np.ndarray, ...]], queries: pa.Table) -> pa.Table:
    ids = np.array(queries.column("id"))[:0]
    cols = [np.concatenate(c) for c in zip((ids, ids, np.zeros(0)), *parts)]
    return pa.table({"id": cols[0], "neighbour": cols[1], "distance": cols[2]})


def _closest(queries: pa.Table, points: pa.Table, k: int, same: bool) -> pa.Table:
    """k nearest points of each query: (id, neighbour, distance), ties to the smaller neighbour."""
    names = np.array(points.column("id"))
    order = np.argsort(names, kind="stable")
    to = _vectors(points.column("v"))
    return _found([_near(np.array(queries.column("id")), _vectors(queries.column("v")), names[order], to[order] if len(order) else to, k, same)], queries)


def _tile(queries: pa.Table, points: pa.Table, k: int) -> pa.Table:
    """k nearest points of each query among those blocks that its own block must be compared with."""
    if not queries.num_rows or not points.num_rows:
        return _found([], queries)
    names = np.array(points.column("id2"))
    order = np.argsort(names, kind="stable")
    names, to, block = names[order], _vectors(points.column("v2"))[order], np.array(points.column("block2"))[order]
    ids, at, own = np.array(queries.column("id")), _vectors(queries.column("v")), np.array(queries.column("block"))
    parts = []
    for q, i in zip(*np.unique(own, return_index=True)):
        met = np.isin(block, queries.column("ts")[int(i)].as_py())
        mine = own == q
        parts.append(_near(ids[mine], at[mine], names[met], to[met], k, False))
    return _found(parts, queries)


def choose_pivots(points: DataFrame, n: int, of: int) -> np.ndarray:
    """n of ``of`` points far from one another, out of PIVOT_SAMPLE at most: each next one is the farthest from those chosen. They decide what is skipped, not what is found.

    The sample has the points with the smallest hashes. A bound on the hash leaves few more than these, or each task would send PIVOT_SAMPLE vectors to the driver.
    """
    share, rows = F.xxhash64(F.lit(1), "id"), points.select("id", "v")
    if of > PIVOT_SAMPLE:
        rows = rows.filter(share < F.lit(int(-(1 << 63) + (1 << 64) * min(0.99, 1.5 * PIVOT_SAMPLE / of))))
    some = np.array([r["v"] for r in rows.orderBy(share, "id").limit(PIVOT_SAMPLE).collect()], float)
    if not len(some):  # only where many ids repeat
        some = np.array([r["v"] for r in points.select("v").limit(1).collect()], float)
    near, chosen = np.full(len(some), np.inf), [0]
    while len(chosen) < min(n, len(some)):
        near = np.minimum(near, np.sqrt(((some - some[chosen[-1]]) ** 2).sum(1)))
        if near.max() == 0:
            break
        chosen.append(int(near.argmax()))
    return some[chosen]


def _to_pivots(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1))
            far = np.stack([np.sqrt(((v - p) ** 2).sum(1)) for p in pivots], axis=1) if v.size else np.zeros((0, len(pivots)))
            cell = far.argmin(1) if v.size else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(list(far), pa.list_(pa.float64())), pa.array(cell.astype(np.int32)), pa.array(far.min(1) if v.size else [], pa.float64())],
                ["id", "v", "far", "cell", "x"],
            )

    return run


def _spans(key: tuple, table: pa.Table) -> pa.Table:
    """Nearest and farthest distance of a block's points to each pivot."""
    far = np.array(table.column("far").to_pylist(), float)
    arrays = [pa.array([list(x)], pa.list_(pa.float64())) for x in (far.min(0), far.max(0))]
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), *arrays], names=["cell", "block", "low", "high"])


def _widest(key: tuple, table: pa.Table) -> pa.Table:
    low, high = np.array(table.column("low").to_pylist(), float).min(0), np.array(table.column("high").to_pylist(), float).max(0)
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([list(low)], pa.list_(pa.float64())), pa.array([list(high)], pa.list_(pa.float64()))], names=["cell", "low", "high"])


def _index(points: DataFrame, k: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points in blocks, the neighbours inside each block, and the pairs of blocks (q, t) that must be compared."""
    n = points.count()
    pivots = choose_pivots(points, min(PIVOTS, max(1, math.ceil(math.sqrt(n / block)))), n) if n else np.zeros((1, 1))
    kind = dict(points.dtypes)["id"]
    placed = points.select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(_to_pivots(pivots), f"id {kind}, v array<double>, far array<double>, cell int, x double")
    ranked = row_rank(placed, ["x", "id"], keys=["cell"])
    rows = cut_lineage(ranked.select("id", "v", "far", "cell", (F.col("cell").cast("long") * (1 << 32) + F.floor((F.col("rank") - 1) / block)).alias("block")))
    schema = f"id {kind}, neighbour {kind}, distance double"
    own = cut_lineage(rows.groupBy("block").applyInArrow(lambda t: _closest(t, t, k, True), schema))
    # The k-th distance inside the block; a block with too few points must look everywhere.
    kth = own.groupBy("id").agg(F.when(F.count(F.lit(1)) == k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("d"))
    reach = rows.select("id", "block").join(kth, "id", "left").groupBy("block").agg(F.max(F.coalesce("d", F.lit(float("inf")))).alias("d"))
    spans = rows.groupBy("cell", "block").applyInArrow(_spans, "cell int, block long, low array<double>, high array<double>")
    # Distances are rounded, so a block is skipped only when it is farther by more than that.
    spans = cut_lineage(spans.join(reach, "block").withColumn("d", F.col("d") * (1 + 1e-9) + 1e-9 * (1 + F.array_max("high"))))
    cells = spans.groupBy("cell").applyInArrow(_widest, "cell int, low array<double>, high array<double>")
    # A cell is as little as its pivot's row of distances: at most PIVOTS rows of PIVOTS numbers.
    every = cells.agg(F.collect_list(F.struct("cell", "low", "high"))).scalar()

    def apart(low, high, low2, high2, d):
        """Whether some pivot sees the two farther apart than d."""
        gaps = F.zip_with(F.zip_with(low2, high, lambda a, b: a - b), F.zip_with(low, high2, lambda a, b: a - b), lambda a, b: F.greatest(a, b))
        return F.coalesce(F.array_max(gaps), F.lit(0.0)) > d

    at = lambda c, i: F.element_at(c, i + 1)
    ring = lambda x, lo, hi: F.greatest(F.lit(0), F.least(F.lit(RINGS - 1), F.when(hi > lo, F.floor((x - lo) / (hi - lo) * RINGS)).otherwise(F.lit(0)))).cast("int")
    near = F.filter("every", lambda c: ~apart(F.col("low"), F.col("high"), c["low"], c["high"], F.col("d")))
    asks = spans.withColumn("every", every).select(F.col("block").alias("q"), "low", "high", "d", F.explode(near).alias("c"))
    base, top = at(F.col("c.low"), F.col("c.cell")), at(F.col("c.high"), F.col("c.cell"))
    first, last = ring(at(F.col("low"), F.col("c.cell")) - F.col("d"), base, top), ring(at(F.col("high"), F.col("c.cell")) + F.col("d"), base, top)
    asks = asks.select("q", "low", "high", "d", F.col("c.cell").alias("cell"), F.explode(F.sequence(first, last)).alias("ring"))
    own_cell = spans.join(cells.select("cell", F.col("low").alias("cl"), F.col("high").alias("ch")), "cell")
    base, top = at(F.col("cl"), F.col("cell")), at(F.col("ch"), F.col("cell"))
    rings = F.sequence(ring(at(F.col("low"), F.col("cell")), base, top), ring(at(F.col("high"), F.col("cell")), base, top))
    targets = own_cell.select("cell", F.col("block").alias("t"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.explode(rings).alias("ring"))
    # Merged: the planner does not see how many rings there are, and would send them all through the driver.
    met = asks.join(targets.hint("merge"), ["cell", "ring"]).filter("q <> t").filter(~apart(F.col("low"), F.col("high"), F.col("low2"), F.col("high2"), F.col("d")))
    return rows, own, cut_lineage(met.select("q", "t").distinct())


def nearest(points: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """k nearest others of every point(id, v), exact: (id, neighbour, distance, nth). Ids are whole numbers, and unique; vectors are finite and of one length.

    Points belong to the cell of the pivot nearest to them, and are cut into blocks by their distance to it. A block's own neighbours bound how far
    the true ones can be. Another block is compared only if no pivot sees it farther away than that (triangle inequality): first whole
    cells are ruled out, then rings of a cell, then single blocks. Blocks travel in groups: a task has the blocks of one group that must be compared with blocks of
    another, and gives k rows for each point, so vectors are sent and rows are given once for a group and not for each block.
    """
    if block <= k:
        raise ValueError("a block must hold more points than neighbours are asked for")
    rows, own, pairs = _index(points, k, block)
    kind = dict(points.dtypes)["id"]
    groups = row_rank(pairs.select(F.col("q").alias("block")).unionByName(pairs.select(F.col("t").alias("block"))).distinct(), ["block"], "n")
    groups = cut_lineage(groups.select("block", F.floor((F.col("n") - 1) / GROUP).alias("g")))
    of = lambda c: groups.select(F.col("block").alias(c), F.col("g").alias(f"g{c}"))
    tiles = cut_lineage(pairs.join(of("q"), "q").join(of("t"), "t").groupBy("gq", "gt", "q").agg(F.collect_list("t").alias("ts")))
    asked = tiles.select("gq", "gt", F.explode("ts").alias("t")).distinct()
    queries = rows.join(tiles.hint("merge"), F.col("block") == F.col("q")).select("gq", "gt", "block", "ts", "id", "v")
    targets = rows.join(asked.hint("merge"), F.col("block") == F.col("t")).select(*[F.col(c).alias(f"{c}2") for c in ("gq", "gt", "block", "id", "v")])
    both = queries.groupBy("gq", "gt").cogroup(targets.groupBy("gq2", "gt2"))
    other = both.applyInArrow(lambda a, b: _tile(a, b, k), f"id {kind}, neighbour {kind}, distance double")
    w = Window.partitionBy("id").orderBy("distance", "neighbour")
    return own.unionByName(other).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k)


def knn_on_components(long: DataFrame, samples: DataFrame, value: str, k: int = 8, components: int = 5) -> DataFrame:
    """k nearest samples on their first principal components: (sample, neighbour, distance, nth)."""
    scores = pca_samples(long, samples, value, components)
    vectors = scores.groupBy("sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("component", "score"))), lambda c: c["score"]).alias("v"))
    numbered = cut_lineage(row_rank(vectors, ["sample"], "id"))
    found = nearest(numbered.select("id", "v"), k)
    names = numbered.select("id", "sample")
    return found.join(names, "id").join(names.select(F.col("id").alias("neighbour"), F.col("sample").alias("__name")), "neighbour").select(
        "sample", F.col("__name").alias("neighbour"), "distance", "nth"
    )
