"""SimHash near-duplicates: Golay-code fuzzy keys, pigeonhole over segments, verified links, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import null_safe_join
from ..session import cut_lineage
from .batches import without
from .linking import components, deal_blocks, forest

# Generator polynomial of the (23, 12, 7) Golay code, and the hash seed of the fingerprint.
GENERATOR, CHECK_BITS, SEED = 0b110001110101, 11, 42

#: Members of one key that a task compares with one another; larger keys are cut into blocks of this size.
BLOCK = 1024
LINK_BITS = 3
_PIECE = 1 << 20


# Fingerprints ---------------------------------------------------------------------------------


def _words(text: str) -> Iterator[list[bytes]]:
    """Lists of lower-cased words. A long text comes in several, so its words are never all held at once."""
    data = text.encode("utf-8").lower()
    start = 0
    while start < len(data):
        end = start + _PIECE
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[start:end].split()
        start = end


def simhash(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash over shingles of ``width`` words; 0 for a text without words."""
    ones, n, tail = np.zeros(64, np.int64), 0, []
    h = xxhash.xxh64_intdigest

    def add(hashes: list[int]) -> None:
        nonlocal ones, n
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
        n += len(hashes)

    for words in _words(text or ""):
        words = tail + words
        if len(words) >= width:
            add([h(b" ".join(words[i : i + width]), SEED) for i in range(len(words) - width + 1)])
        tail = words[-(width - 1) :] if width > 1 else []
    if n == 0:
        if not tail:
            return 0
        add([h(b" ".join(tail), SEED)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, width: int = 3) -> Column:
    """SimHash as a signed long (the same 64 bits)."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, width) for t in texts], np.uint64).view(np.int64))

    return of(text)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# Golay keys -----------------------------------------------------------------------------------


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Codeword index of every 16-bit word (seven zero bits complete it to 23), and the indices of each word and its 16 neighbours."""

    def syndrome(word: int) -> int:
        for bit in range(22, CHECK_BITS - 1, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - CHECK_BITS)
        return word

    unit = [syndrome(1 << b) for b in range(23)]
    fix = np.zeros(1 << CHECK_BITS, np.int64)
    for a in range(23):
        fix[unit[a]] = 1 << a
        for b in range(a):
            fix[unit[a] ^ unit[b]] = 1 << a | 1 << b
            for c in range(b):
                fix[unit[a] ^ unit[b] ^ unit[c]] = 1 << a | 1 << b | 1 << c
    words = np.arange(1 << 16)
    syn = np.zeros(1 << 16, np.int64)
    for b in range(16):
        syn ^= np.where(words >> b & 1, unit[b], 0)
    index = (words ^ fix[syn]) >> CHECK_BITS
    near = np.stack([index, *[index[words ^ (1 << b)] for b in range(16)]], axis=1)
    near.sort(axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    return index, near


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``fps``, key) pairs such that two fingerprints within three bits share a key.

    Over four 16-bit segments, three errors leave either two segments exact, or one exact and one error
    in each of the others. The first case shares the key of an exact pair of segments. In the second, the
    exact segment goes with the Golay indices of the next one and its neighbours: words one bit apart decode
    to a common index there.
    """
    _, near = _tables()
    seg = [(fps >> np.uint64(16 * s) & np.uint64(0xFFFF)).astype(np.int64) for s in range(4)]
    at = np.arange(len(fps))
    places, keys, tag = [], [], 0
    for i in range(4):
        for j in range(i + 1, 4):
            places.append(at)
            keys.append(tag << 32 | seg[i] << 16 | seg[j])
            tag += 1
    for i in range(4):
        fuzzy = near[seg[(i + 1) % 4]]
        row, col = np.nonzero(fuzzy >= 0)
        places.append(row)
        keys.append(tag << 32 | seg[i][row] << 12 | fuzzy[row, col])
        tag += 1
    return np.concatenate(places), np.concatenate(keys)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 20000):
            fps = batch.slice(start, 20000).column(0).to_numpy().view(np.uint64)
            place, key = keys_of(fps)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[place].view(np.int64))], ["key", "fp"])


def link_group(fps: np.ndarray, bits: int = LINK_BITS) -> list[tuple[int, int]]:
    """(member, smallest member of its component) for one group of fingerprints within ``bits`` of each other."""
    return forest(len(fps), lambda s, e: np.bitwise_count(fps[s:e, None] ^ fps[None, :]) <= bits)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside runs of equal (key, p, q); the rows come sorted, and a run may go on in the next batch."""
    held: list[np.ndarray] | None = None

    def out(arrays: list[np.ndarray]) -> pa.RecordBatch:
        key, fp = arrays[:3], arrays[3].view(np.uint64)
        change = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])) + 1
        starts = np.concatenate([[0], change])
        sizes = np.diff(np.concatenate([starts, [len(fp)]]))
        two = starts[sizes == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= LINK_BITS]
        a, b = [fp[two]], [fp[two + 1]]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            group = fp[s : s + n]
            if linked := link_group(group):
                pairs = np.array(linked)
                a.append(group[pairs[:, 0]])
                b.append(group[pairs[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    for batch in batches:
        if batch.num_rows == 0:
            continue
        arrays = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if held is not None:
            arrays = [np.concatenate([h, x]) for h, x in zip(held, arrays)]
        last = (arrays[0] == arrays[0][-1]) & (arrays[1] == arrays[1][-1]) & (arrays[2] == arrays[2][-1])
        cut = int(np.argmax(last))
        if cut:
            yield out([x[:cut] for x in arrays])
        held = [x[cut:] for x in arrays]
    if held is not None:
        yield out(held)


def near_links(fps: DataFrame) -> DataFrame:
    """(a, b) between different fingerprints, enough to connect all that are linked by steps of three bits or fewer.

    ``fps`` has one column ``fp`` of distinct values. Within a key the links are a spanning forest, so a dense group
    gives as many rows as it has members. A key with more than BLOCK members is dealt by pairs of blocks, so
    no task gets a whole hot key, and every pair of its members still meets.
    """
    keys = fps.select("fp").mapInArrow(_keys, "key long, fp long")
    dealt = deal_blocks(keys, "fp", BLOCK)
    runs = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "fp")
    return runs.mapInArrow(_links, "a long, b long").distinct()


# Groups ---------------------------------------------------------------------------------------


def group_near(rows: DataFrame, fp: str = "fp", id: str = "doc_id") -> DataFrame:
    """Rows with component_id: the smallest id reachable by links of three bits or fewer.

    Equal fingerprints are one node, so copies never make pairs. The fingerprint zero of texts without
    words links like any other. Null ids count as missing: they never name a component unless it has no
    other. An empty table gives no rows; other columns pass through, but one named component_id is replaced.
    """
    rows = without(rows, ["component_id"], [fp, id])
    nodes = cut_lineage(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(id).alias("low")))
    roots = components(near_links(nodes)).withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    of = placed.join(named, "root").select(F.col("fp").alias(fp), "component_id")
    return null_safe_join(rows, of, [fp])


def keep_one_of_each(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Documents with one row of each near-duplicate group: the one with the smallest id, columns unchanged.

    Null texts count as empty, and all texts without words are one group. Rows that repeat the smallest id leave the
    smallest row by the other columns.
    """
    row = F.struct(*[F.col(c) for c in docs.columns])  # apart from the columns made here, whatever its names are
    marked = cut_lineage(docs.select(F.col(id).alias("__id"), fingerprint(F.col(text)).alias("__fp"), row.alias("__row")))
    grouped = group_near(marked, "__fp", "__id").filter(F.col("__id").eqNullSafe(F.col("component_id")))
    first = grouped.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("__fp")).alias("__of")).agg(F.min("__row").alias("__row"))
    return first.select("__row.*")
