"""Hard negatives: clusters of anchors share lists of candidates in the order of an angular bound, walked until no better row can follow."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .batches import bounded_sample

#: Anchors that the cluster centres are fitted on, most clusters, anchors that share a list, anchors of one cell of the grid.
SAMPLE_ANCHORS, CLUSTERS, MEMBERS, CELL_ANCHORS = 4096, 256, 256, 4096
#: Bytes of candidate vectors of one cell, and candidates compared at a time.
PART_BYTES, STEP = 4 << 20, 512
_EXACT = 2**53
_LONG = 2**63 - 1


# Rows -----------------------------------------------------------------------------------------


def usable(rows: DataFrame, anchor: Column, vector: str, label: str, id: str, scale: int) -> DataFrame:
    """(row, id, label, v, anchor): rows with a label and a vector of finite numbers, each component x as floor(scale * x); ``row`` numbers the rows."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    named = rows.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    good = named.filter(F.col("label").isNotNull() & F.col("v").isNotNull()).filter(~F.exists("v", odd))
    return good.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("v"), "anchor")


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of whole doubles; shorter ones end in zeros. Whole numbers that a double may not hold come as Python's."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    sizes = np.concatenate([np.zeros(0, np.int64), *[pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in chunks]]).astype(np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *[c.flatten().to_numpy(zero_copy_only=False) for c in chunks]])
    big = len(flat) and max(abs(int(flat.max())), abs(int(flat.min()))) >= _EXACT
    out = np.zeros((len(sizes), width), object if big else float)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = flat
    return out


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m.astype(float) ** 2).sum(1))


def _angles(m: np.ndarray, norms: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Angles to a centre of length one; 0 for a zero vector."""
    cosine = np.where(norms > 0, (m.astype(float) @ centre) / np.maximum(norms, 1e-300), 1.0)
    return np.arccos(np.clip(cosine, -1, 1))


# Clusters of anchors --------------------------------------------------------------------------


def fit_centres(sample: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k directions among which the sample's directions fall: spherical k-means from rows spread over the sample."""
    unit = sample / np.maximum(_norms(sample)[:, None], 1e-300)
    centres = unit[np.arange(k) * len(unit) // k].copy()
    for _ in range(rounds):
        own = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        size = _norms(sums)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size[:, None], 1e-300), centres)
    dead = _norms(centres) == 0
    centres[dead, 0] = 1.0
    return centres


def _assign(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = (_matrix(batch.column(1), centres.shape[1]).astype(float) @ centres.T).argmax(1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32))], ["row", "cluster"])

    return run


def cluster(anchors: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """anchors with cluster and list: anchors of a cluster that share a list, about MEMBERS or fewer; and the centres.

    Centres are fitted on at most SAMPLE_ANCHORS anchors; every anchor gets the nearest. They decide how early walks end, not what they find.
    """
    sample = _matrix(pa.array([list(r[0]) for r in bounded_sample(anchors.select("v", "row"), SAMPLE_ANCHORS, "row").select("v").collect()], pa.list_(pa.int64())), width)
    centres = fit_centres(sample.astype(float), min(CLUSTERS, math.ceil(math.sqrt(len(sample)))))
    of = cut_lineage(anchors.select("row", "v").mapInArrow(_assign(centres), "row long, cluster int"))
    sizes = {r["cluster"]: r["n"] for r in of.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    lists = F.lit(np.array([math.ceil(sizes.get(c, 1) / MEMBERS) for c in range(len(centres))]).tolist())
    placed = of.withColumn("list", F.pmod(F.xxhash64("row"), lists[F.col("cluster")]).cast("int"))
    return anchors.join(placed, "row"), centres


# Walks ----------------------------------------------------------------------------------------


class _Side:
    """Rows of one side of a cell. Candidates lie in the order of ties: ascending id, null last, then the row's number."""

    def __init__(self, table: pa.Table, width: int):
        self.table = table
        self.v = _matrix(table.column("v"), width)
        self.norms = _norms(self.v)
        self.row = table.column("row").to_numpy()
        self.label = table.column("label").to_numpy()


def _scores(v: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Whole inner products of rows and columns; beyond the range of a long they stay at its ends."""
    top = lambda m: max((abs(float(x)) for x in (m.max(), m.min())), default=0.0) if m.size else 0.0
    if v.dtype != object and u.dtype != object and top(v) * top(u) * max(1, v.shape[1]) < _EXACT:
        return (v @ u.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return np.clip(whole(v) @ whole(u).T, -_LONG - 1, _LONG).astype(np.int64)


def walk(candidates: _Side, members: _Side, centre: np.ndarray, spans: list[list[tuple[int, int]]], k: int, wanted: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[list[list[tuple[int, int]]]], int]:
    """For each member and each of its spans of scores the k best (-score, candidate); also the number of scores computed.

    A candidate at angle t to the centre is at least t - b away from each member, b being the largest angle of a member, so no
    score exceeds |member| |candidate| cos(max(0, t - b)). The candidates are sorted by this once. A member walks the list in steps and
    stops when the bound of the next candidate is below the k-th score, or the lowest wanted one, of every span. The angles are
    widened and the bounds raised by more than their rounding error. ``wanted(member, candidates)`` says which rows take part.
    """
    widest = float(_angles(members.v, members.norms, centre).max()) + 1e-6
    apart = np.maximum(0.0, _angles(candidates.v, candidates.norms, centre) - widest)
    reach = candidates.norms * (np.cos(apart) + 1e-9)
    order = np.argsort(-reach, kind="stable")
    v, reach = candidates.v[order], reach[order]
    best: list[list[list[tuple[int, int]]]] = [[[] for _ in s] for s in spans]
    least = [[low for low, _ in s] for s in spans]  # a score below is of no use any more
    active = np.array([i for i, s in enumerate(spans) if s], np.int64)
    scored = 0
    for start in range(0, len(order), STEP):
        here = order[start : start + STEP]
        ahead = np.maximum(reach[start] * members.norms[active], -float(2**63)).tolist()
        active = np.array([m for bound, m in zip(ahead, active.tolist()) if bound >= min(least[m])], np.int64)
        if len(active) == 0:
            break
        scores = _scores(v[start : start + STEP], members.v[active])
        scored += scores.size
        for j, m in enumerate(active.tolist()):
            mine, ok = scores[:, j], wanted(m, here)
            for s, (low, high) in enumerate(spans[m]):
                use = np.flatnonzero(ok & (mine >= least[m][s]) & (mine <= high))
                if len(use) == 0:
                    continue
                found = sorted(best[m][s] + [(-x, c) for x, c in zip(mine[use].tolist(), here[use].tolist())])[:k]
                best[m][s] = found
                if len(found) == k:
                    least[m][s] = max(least[m][s], -found[-1][0])
    return best, scored


def _cell(centres: np.ndarray, k: int, same: bool, low: int, high: int):
    """What one cell finds: (anchor, span, id, row, score). ``same``: the best rows of the anchor's label, else for each of its
    positives the best rows of other labels whose score is between ``low`` and ``high`` hundredths of the positive's."""
    fields = ("anchor", "span", "id", "row", "score")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), left.schema.field("id").type, pa.int64(), pa.int64())], names=fields)
        if left.num_rows == 0 or right.num_rows == 0:
            return empty
        left = left.take(pc.sort_indices(left, sort_keys=[("id", "ascending"), ("row", "ascending")], null_placement="at_end"))
        candidates = _Side(left, centres.shape[1])
        right = right.sort_by([("cluster", "ascending"), ("list", "ascending"), ("row", "ascending")])
        lists = np.stack([right.column(c).to_numpy() for c in ("cluster", "list")])
        cuts = [0, *(np.flatnonzero((lists[:, 1:] != lists[:, :-1]).any(0)) + 1).tolist(), right.num_rows]
        out: tuple[list, ...] = ([], [], [], [])
        for a, b in zip(cuts[:-1], cuts[1:]):
            members = _Side(right.slice(a, b - a), centres.shape[1])
            if same:
                spans = [[(-_LONG - 1, _LONG)]] * (b - a)
            else:
                positives = right.column("positives").slice(a, b - a).to_pylist()
                spans = [[(-(-low * p // 100), high * p // 100) for p in ps] for ps in positives]
                spans = [[x if x[0] <= x[1] else (_LONG, -_LONG) for x in s] for s in spans]

            def wanted(m: int, at: np.ndarray) -> np.ndarray:
                equal = candidates.label[at] == members.label[m]
                return equal & (candidates.row[at] != members.row[m]) if same else ~equal

            best, _ = walk(candidates, members, centres[lists[0, a]], spans, k, wanted)
            for m, row in enumerate(members.row.tolist()):
                for s, found in enumerate(best[m]):
                    for score, c in found:
                        for column, x in zip(out, (row, s, c, -score)):
                            column.append(x)
        at = pa.array(out[2], pa.int64())
        return pa.table(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), left.column("id").take(at), left.column("row").take(at), pa.array(out[3], pa.int64())], names=fields
        )

    return run


def _grid(rows: DataFrame, anchors: DataFrame, parts: int, groups: int, run: Callable, id_kind: str) -> DataFrame:
    """Every part of the rows meets every group of the anchors in one cell, a task's work of bounded size."""
    part, group = F.pmod(F.xxhash64("row"), F.lit(parts)), F.pmod(F.xxhash64("cluster", "list"), F.lit(groups))
    left = rows.withColumn("part", part).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    right = anchors.withColumn("group", group).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    met = left.groupBy("part", "group").cogroup(right.groupBy("part", "group"))
    return met.applyInArrow(run, f"anchor long, span int, id {id_kind}, row long, score long")


# Mining ---------------------------------------------------------------------------------------


def mine(
    rows: DataFrame, anchor: Column, vector: str = "embedding", label: str = "label", id: str = "vec_id", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    scale: int = 256, part_bytes: int = PART_BYTES, cell_anchors: int = CELL_ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows for which ``anchor`` holds.

    A row's score is the inner product of its vector, each component x as floor(scale * x), with the anchor's. An anchor's positives are its best ``positives``
    other rows of the same label; for each, its negatives are the best ``negatives`` rows of another label whose score is between ``low`` and
    ``high`` hundredths of the positive's score. Higher scores come first, then smaller ids, null ids last.

    Anchors are dealt to cells by clusters, all rows to cells by their number; a cell holds about ``cell_anchors`` anchors and ``part_bytes`` of
    vectors, whatever the labels and copies, and gives its best rows, of which the best of all cells are taken. No candidate is left out but by the
    certified end of a walk (:func:`walk`).

    Rows with a null label, a null vector, or a null or non-finite component take no part; empty vectors score 0 and shorter ones end in zeros. ``anchor`` is a condition on
    the columns of ``rows``. Rows that repeat an id are rows of their own (an anchor's copy is another row). Components and scores beyond
    the range of a long stay at its ends. Without anchors, and for an empty table, there are no rows; other columns are not read.
    """
    spark = rows.sparkSession
    table = cut_lineage(usable(rows, anchor, vector, label, id, scale))
    asked = table.filter("anchor").drop("anchor")
    rows_n, width = table.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n, width = asked.count(), max(1, width)
    kind = table.schema["id"].dataType.simpleString()
    if n == 0:
        return spark.createDataFrame([], f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long")
    placed, centres = cluster(asked, width)
    placed = cut_lineage(placed)
    candidates = table.drop("anchor")
    parts, groups = math.ceil(rows_n * (8 * width + 32) / part_bytes), math.ceil(n / cell_anchors)
    first = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]

    found = _grid(candidates, placed, parts, groups, _cell(centres, positives, True, low, high), kind)
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(*first))
    best = cut_lineage(found.withColumn("span", place - 1).filter(F.col("span") < positives))
    scores = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("span", "score")))["score"].alias("positives"))
    second = placed.join(scores, F.col("row") == F.col("anchor")).drop("anchor")

    found = _grid(candidates, second, parts, groups, _cell(centres, negatives, False, low, high), kind)
    rank = F.row_number().over(Window.partitionBy("anchor", "span").orderBy(*first))
    worst = found.withColumn("rank", rank).filter(F.col("rank") <= negatives).select("anchor", "span", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    told = best.select("anchor", "span", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return worst.join(told, ["anchor", "span"]).join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
