"""Ranked lexical search: exact inner products by best-first walks over sparse ball trees of documents."""

from __future__ import annotations

import heapq
import math
import re
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .batches import slices

#: Items of one pass over the documents: as many as hold about this much text. Their terms are what the driver and the tasks hold.
BLOCK_BYTES = 64 << 10
#: Term occurrences in one tree (a document counts as ROW_CELLS of them besides), documents in one leaf, and kinds of items.
TREE_CELLS, ROW_CELLS, LEAF, KINDS = 1 << 21, 128, 64, 16
SALTS = 32
_PIECE = 1 << 20
_EPS = 2.0**-52

# Terms are runs of digits, letters and everything beyond ASCII, A-Z in lower case; the numbers of the score.
_TERM_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
SCALE, TF_WEIGHT, LENGTH_WEIGHT, LENGTH_SHARE, IDF_SCALE = 1_000_000_000, 1000, 12, 25, 1000


# Terms ----------------------------------------------------------------------------------------


def terms_of(data: bytes) -> Iterator[list[bytes]]:
    """Terms of a whole text in UTF-8, in several lists when it is long."""
    start = 0
    while start < len(data):
        cut = _BREAK.search(data, start + _PIECE)
        end = cut.start() if cut else len(data)
        yield data[start:end].translate(_TERM_BYTES).split()
        start = end


def _count(known: dict[bytes, int]):
    """Rows of (id, n, term, tf): all terms counted in n, those of the items listed in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.get
        for whole in batches:
            for part in slices(whole, "text", 8 << 20):
                lengths, sizes, terms, counts = [], [], [], []
                for cell in part.column(1):
                    n, found = 0, Counter()
                    for words in terms_of(cell.as_py() or b""):
                        n += len(words)
                        found.update(map(get, words))
                    found.pop(None, None)
                    lengths.append(n)
                    sizes.append(len(found))
                    terms.extend(found)
                    counts.extend(found.values())
                sizes = np.array(sizes, np.int64)
                terms, counts = np.array(terms, np.int32), np.array(counts, np.int32)
                order = np.lexsort((terms, np.repeat(np.arange(len(sizes)), sizes)))
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                arrays = [part.column(0), pa.array(lengths, pa.int64()), *[pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (terms, counts)]]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "term", "tf"])

    return run


def _holding(width: int):
    """Rows of (term, df) of one task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(width, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=width)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["term", "df"])

    return run


# Trees ----------------------------------------------------------------------------------------


@dataclass
class Sparse:
    """Rows of (index, value), laid end to end; no row is empty."""

    ends: np.ndarray
    index: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.ends) - 1

    def dot(self, dense: np.ndarray, start: int = 0, end: int | None = None) -> np.ndarray:
        a, b = self.ends[start], self.ends[-1 if end is None else end]
        return np.add.reduceat(dense[self.index[a:b]] * self.value[a:b], self.ends[start : -1 if end is None else end] - a)

    def take(self, rows: np.ndarray) -> Sparse:
        sizes = self.ends[rows + 1] - self.ends[rows]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.ends[rows] - ends[:-1], sizes) + np.arange(ends[-1])
        return Sparse(ends, self.index[at], self.value[at])


@dataclass
class Items:
    """What a task needs of the items of one pass: term counts by item, weights by term, the numbers of the collection, and how bounds see the terms.

    A term of one item only is in that item's group, the others in the group of the kind of items that has most of them (a language, say): an
    item then meets the spread of few documents in few groups.
    """

    keys: list[int]
    counts: Sparse
    weights: np.ndarray
    documents: int
    occurrences: int

    def __post_init__(self) -> None:
        index, n, width = self.counts.index, len(self.keys), len(self.weights)
        of = np.repeat(np.arange(n), np.diff(self.counts.ends))
        kind = _kinds(self.counts, width)
        k = int(kind.max()) + 1
        holders = np.bincount(index, minlength=width)
        common = np.bincount(kind[of] * width + index, minlength=k * width).reshape(k, width).argmax(0)
        owner = np.zeros(width, np.int64)
        owner[index] = of
        self.group = np.where(holders == 1, k + owner, common)
        self.scale = 1 / np.sqrt(np.maximum(self.weights, 1))
        squares = np.bincount(of * (k + n) + self.group[index], weights=(self.counts.value / self.scale[index]) ** 2, minlength=n * (k + n))
        self.lengths = np.sqrt(squares).reshape(n, k + n)


def _kinds(counts: Sparse, width: int, k: int = KINDS, rounds: int = 8) -> np.ndarray:
    """A number below ``k`` for each item: items that share terms get the same one."""
    n = len(counts)
    ones = Sparse(counts.ends, counts.index, np.ones(len(counts.index)))
    of = np.repeat(np.arange(n), np.diff(counts.ends))
    k = min(k, n)
    seeds, kind = np.arange(k) * n // k, None
    for _ in range(rounds):
        centres = np.zeros((k, width))
        if kind is None:
            for c, i in zip(centres, seeds):
                c[ones.index[ones.ends[i] : ones.ends[i + 1]]] = 1
        else:
            np.add.at(centres, (kind[of], ones.index), 1)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        kind = np.stack([ones.dot(c) for c in centres]).argmax(0)
    return kind


@dataclass
class Tree:
    """Nodes of a ball tree: for each its bounds by item, its children, and its run of points in ``order``."""

    bounds: list[np.ndarray] = field(default_factory=list)
    children: list[tuple[int, int] | None] = field(default_factory=list)
    runs: list[tuple[int, int]] = field(default_factory=list)
    order: list[np.ndarray] = field(default_factory=list)


def build(points: Sparse, items: Items, leaf: int = LEAF) -> Tree:
    """Ball tree over ``points`` with bounds on every inner product of an item with a point below a node.

    Terms are stretched by ``items.scale`` and fall into groups; a ball is the mean of its points and, for each group of terms, the largest distance of
    a point to it there. A bound is centre . item + the sum over the groups of radius x length of the item. Squared distances, products and the sum
    are each raised by more than their rounding error, so a bound is never below a true score.

    A ball is split by two points far apart, and at the median between them when that would leave less than an eighth on one side,
    so the depth is logarithmic.
    """
    width, groups = len(items.weights), items.lengths.shape[1]
    tree, placed, slack = Tree(), 0, 8 * (width + groups + 64) * _EPS
    total = items.lengths.sum(1)
    todo = [(np.arange(len(points)), Sparse(points.ends, points.index, points.value * items.scale[points.index]), -1, 0)]
    while todo:
        rows, x, parent, side = todo.pop()
        n = len(rows)
        centre = np.bincount(x.index, weights=x.value, minlength=width) / n
        squares = np.add.reduceat(x.value**2, x.ends[:-1])
        size = float(centre @ centre)
        cell = np.repeat(np.arange(n) * groups, np.diff(x.ends)) + items.group[x.index]
        away = np.bincount(cell, weights=x.value * (x.value - 2 * centre[x.index]), minlength=n * groups).reshape(n, groups)
        away += np.bincount(items.group, weights=centre**2, minlength=groups)
        radius = np.sqrt(np.maximum(away.max(0), 0) + slack * (float(squares.max()) + size))
        near = items.counts.dot(centre / items.scale)
        node = len(tree.bounds)
        tree.bounds.append((near + items.lengths @ radius + slack * total * math.sqrt(size)) * (1 + slack) + 1e-6)
        tree.children.append(None)
        tree.runs.append((placed, placed))
        if parent >= 0:
            known = tree.children[parent] or (0, 0)
            tree.children[parent] = (node, known[1]) if side == 0 else (known[0], node)
        if n <= leaf:
            tree.runs[node] = (placed, placed + n)
            tree.order.append(rows)
            placed += n
            continue

        def from_point(i: int) -> np.ndarray:
            dense = np.zeros(width)
            dense[x.index[x.ends[i] : x.ends[i + 1]]] = x.value[x.ends[i] : x.ends[i + 1]]
            return squares + squares[i] - 2 * x.dot(dense)

        first = from_point(int(away.sum(1).argmax()))
        lean = first - from_point(int(first.argmax()))
        left = lean <= 0
        if min(left.sum(), (~left).sum()) < n / 8:
            left = np.zeros(n, bool)
            left[np.argsort(lean, kind="stable")[: n // 2]] = True
        for side, part in ((1, np.flatnonzero(~left)), (0, np.flatnonzero(left))):
            todo.append((rows[part], x.take(part), node, side))
    return tree


def walk(tree: Tree, points: Sparse, query: np.ndarray, item: int, k: int, least: int, copies: list[np.ndarray]) -> tuple[list[tuple[int, int]], int]:
    """The k best (-score, row) of one item with score above 0 and at least ``least``, best-first; also the points that were scored.

    ``points`` lie in the order of the tree; scores are whole numbers. A subtree is left out only when its bound is below the k-th score.
    """
    best: list[tuple[int, int]] = []
    heap, scored = [(-tree.bounds[0][item], 0)], 0
    while heap:
        bound, node = heapq.heappop(heap)
        if -bound < least:
            break
        if tree.children[node]:
            for child in tree.children[node]:
                if tree.bounds[child][item] >= least:
                    heapq.heappush(heap, (-tree.bounds[child][item], child))
            continue
        start, end = tree.runs[node]
        scores = points.dot(query, start, end)
        scored += end - start
        for i in np.flatnonzero(scores >= max(least, 1)).tolist():
            score = int(scores[i])
            if score < least:
                continue
            for row in copies[start + i].tolist():
                insort(best, (-score, row))
            del best[k:]
            if len(best) == k:
                least = max(least, -best[-1][0])
    return best, scored


def _vectors(batch: pa.Table, items: Items) -> tuple[Sparse, np.ndarray]:
    """Weighted whole-number vectors of documents, and the row of each; documents without any of the terms are left out."""
    lists, tf = batch.column("term").combine_chunks(), batch.column("tf").combine_chunks()
    lists, tf = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (lists, tf))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    index = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    tf = tf.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = batch.column("n").to_pylist()
    m = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * n * items.documents // items.occurrences for n in lengths], np.int64)
    value = items.weights[index] * (SCALE * tf // (TF_WEIGHT * tf + LENGTH_WEIGHT * np.repeat(m, sizes)))
    rows = np.flatnonzero(sizes)
    return Sparse(np.concatenate([[0], np.cumsum(sizes[rows])]), index, value), rows


def _distinct(points: Sparse, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """One of each set of equal vectors, and the first k of each set: no more of them can be among the k best."""
    sets: dict[bytes, list[int]] = {}
    for i in range(len(points)):
        a, b = points.ends[i], points.ends[i + 1]
        sets.setdefault(points.index[a:b].tobytes() + points.value[a:b].tobytes(), []).append(i)
    return np.array([s[0] for s in sets.values()]), [np.array(s[:k]) for s in sets.values()]


def search_table(table: pa.Table, items: Items, k: int, least: list[int]) -> tuple[list[list[tuple[int, int]]], int]:
    """For each item the k best (-score, row of ``table``), rows in ascending order at ties, from one tree; and the points scored."""
    points, rows = _vectors(table, items)
    if len(rows) == 0:
        return [[] for _ in items.keys], 0
    single, copies = _distinct(points, k)
    points = points.take(single)
    tree = build(points, items)
    order = np.concatenate(tree.order)
    points, copies = points.take(order), [rows[copies[i]] for i in order]
    out, scored = [], 0
    query = np.zeros(len(items.weights), np.int64)
    for item in range(len(items.keys)):
        a, b = items.counts.ends[item], items.counts.ends[item + 1]
        query[items.counts.index[a:b]] = items.counts.value[a:b]
        best, n = walk(tree, points, query, item, k, least[item], copies)
        query[items.counts.index[a:b]] = 0
        out.append(best)
        scored += n
    return out, scored


def _search(items: Items, k: int, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, top = [0] * len(items.keys), [[] for _ in items.keys]

        def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            table = table.take(pc.sort_indices(table.column("id"), null_placement="at_end"))
            keys, at, scores = [], [], []
            for item, best in enumerate(search_table(table, items, k, least)[0]):
                keys += [items.keys[item]] * len(best)
                at += [row for _, row in best]
                scores += [-s for s, _ in best]
                top[item] = heapq.nlargest(k, top[item] + [-s for s, _ in best])
                least[item] = top[item][-1] if len(top[item]) == k else 0
            ids = table.column("id").take(pa.array(at, pa.int64())).combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) and ids.num_chunks else pa.array(ids.to_pylist(), table.schema.field("id").type)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), ids, pa.array(scores, pa.int64())], ["item", "id", "score"])

        held, size = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                held.append(part)
                size += len(part.column(2).flatten()) + ROW_CELLS * part.num_rows
                if size >= cells:
                    yield from found(held)
                    held, size = [], 0
        if held:
            yield from found(held)

    return run


# Search ---------------------------------------------------------------------------------------


def _pass(docs: DataFrame, rows: list[tuple[int, bytes]], k: int, cells: int) -> DataFrame | None:
    """(item, id, score): the k best of each task for the items ``rows``; None when nothing can score."""
    known: dict[bytes, int] = {}
    counted = []
    for key, data in rows:
        c = Counter(w for words in terms_of(data) for w in words)
        if c:
            counted.append((key, sorted((known.setdefault(w, len(known)), n) for w, n in c.items())))
    if not counted:
        return None
    kind = docs.schema["id"].dataType.simpleString()
    table = cut_lineage(docs.mapInArrow(_count(known), f"id {kind}, n long, term array<int>, tf array<int>").filter("n > 0"))
    documents, occurrences = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if documents == 0:
        return None
    held = table.select("term").mapInArrow(_holding(len(known)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weights = np.zeros(len(known), np.int64)
    for term, df in held.collect():
        weights[term] = math.floor(IDF_SCALE * math.log((2 * documents + 2) / (2 * df + 1)))
    flat = [p for _, c in counted for p in c]
    counts = Sparse(
        np.concatenate([[0], np.cumsum([len(c) for _, c in counted])]), np.array([t for t, _ in flat], np.int64), np.array([n for _, n in flat], np.int64)
    )
    items = Items([key for key, _ in counted], counts, weights, documents, occurrences)
    return table.filter(F.size("term") > 0).mapInArrow(_search(items, k, cells), f"item long, id {kind}, score long")


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, text: str = "text", id: str = "doc_id", item_text: str = "text", item_id: str = "item_id",
    block_bytes: int = BLOCK_BYTES, cells: int = TREE_CELLS,
) -> DataFrame:
    """(item_id, rank, id, score): the k documents with the highest scores above 0 for each item, equal scores by ascending id.

    The score is the sum over the item's terms, repeats included, of w x f: w = floor(1000 ln((2N + 2) / (2 df + 1))) and
    f = (10^9 tf) div (1000 tf + 12 m), m = 75 + (25 n N) div L, all numbers over the whole table. Only terms of the items can add to a score,
    so a document is its vector over them, times w. Each task lays its documents into ball trees of about ``cells`` term occurrences and
    walks each for every item; equal vectors are one point. What the tasks find is combined salt by salt, then by item.

    Items are taken in passes of about ``block_bytes`` of text (a longer item comes alone), so the terms that driver and tasks hold are
    bounded however many items there are; each pass reads the documents once and stores their counts.

    Null and empty texts have no terms: such documents are not counted, such items have no rows. Rows that repeat
    an id are documents (or items) of their own; null ids come last among equal scores. Ids that are not int, long or string are
    compared and returned as strings. Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    if kind not in ("bigint", "int", "string"):
        rows, kind = rows.withColumn("id", F.col("id").cast("string")), "string"
    asked = cut_lineage(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(item_text).cast("binary").alias("text")))
    size = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = math.ceil(2 * size / block_bytes)
    found = spark.createDataFrame([], f"item long, id {kind}, score long")
    for b in range(1 if size <= block_bytes else blocks):
        block = asked if size <= block_bytes else asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        part = _pass(rows, [(r["item"], bytes(r["text"])) for r in block.filter("text is not null").collect()], k, cells)
        if part is not None:
            found = found.unionByName(part)
    best = [F.desc("score"), F.asc_nulls_last("id")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("id", "score"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*best))).filter(F.col("rank") <= k)
    ranked = some.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).filter(F.col("rank") <= k)
    named = ranked.join(asked.select("item", "item_id"), "item")
    return named.select(F.col("item_id").alias(item_id), "rank", F.col("id").alias(id), "score")
