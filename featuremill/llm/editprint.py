"""Document fingerprints by randomised edit embedding: shared random walks over characters, then sampled bits.

A walk copies characters to an output. At every output step it copies the character under it, and a coin
shared by all texts, thrown for that step and that character, says whether it moves on. Two texts that
agree keep in step; after an edit the walks differ until their offsets meet again, so edit distance turns into
Hamming distance of the outputs (Chakraborty, Goldenberg and Koucky). A fingerprint samples the output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .batches import bounded_sample, slices, without
from .linking import components, deal_blocks, forest

#: Samples of a fingerprint, one byte each; output characters that a sample covers; period and classes of the coins.
SAMPLES, SPAN, PERIOD, CLASSES, SEED = 128, 6, 4096, 256, 2024
#: Members of a band that are compared with one another in one group.
BLOCK = 512
_FEW = 24


@cache
def _stay() -> np.ndarray:
    """Steps that the walk spends on a character of each class when it arrives at each step (modulo PERIOD), flat."""
    coin = np.random.default_rng(SEED).integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
    coin[:, -1] = 1
    stay = np.ones((CLASSES, PERIOD), np.uint8)
    for step in range(PERIOD - 2, -1, -1):
        stay[:, step] = np.where(coin[:, step] == 1, 1, stay[:, step + 1] + 1)
    return stay.ravel()


@cache
def _records() -> list[np.ndarray]:
    """For each sample, the output steps that hold the lowest random priority among all steps before the next one.

    The sample of an output of n steps is the last of them below n: uniform over the output, and the same for two outputs
    of about equal length in most cases. The gaps are drawn as they are distributed, so there is no longest text.
    """
    rng, out = np.random.default_rng(SEED + 1), []
    for _ in range(SAMPLES):
        steps, low = [0], rng.random()
        while steps[-1] < 1 << 40:
            steps.append(steps[-1] + int(rng.geometric(max(low, 1e-13))))
            low *= rng.random()
        out.append(np.array(steps, np.int64))
    return out


def _class(chars: np.ndarray) -> np.ndarray:
    return ((chars * np.uint32(2654435761)) >> np.uint32(24)).astype(np.int64) * PERIOD


def _walk(classes: np.ndarray, first: np.ndarray, sizes: np.ndarray, step: np.ndarray, arrive: np.ndarray) -> np.ndarray:
    """Fill ``arrive`` with the output step at which each character's turn comes; gives the length of each output.

    All texts walk together, longest first. When few are left, each goes on alone.
    """
    stay, order = _stay(), np.argsort(-sizes, kind="stable")
    at, left, now = first[order].copy(), sizes[order], step[order].copy()
    i = 0
    active = int(np.count_nonzero(left > 0))
    while active > _FEW:
        upto = int(left[active - 1])
        p, s = at[:active], now[:active]
        for _ in range(upto - i):
            arrive[p] = s
            s += stay[classes[p] + (s & (PERIOD - 1))]
            p += 1
        i = upto
        active = int(np.count_nonzero(left > i))
    table = stay.tobytes()
    for k in range(active):
        s, begin, end = int(now[k]), int(at[k]), int(at[k] + left[k] - i)
        steps = []
        for c in classes[begin:end].tolist():
            steps.append(s)
            s += table[c + (s & (PERIOD - 1))]
        arrive[begin:end] = steps
        now[k] = s
    out = np.empty_like(now)
    out[order] = now
    return out


def _sample(chars: np.ndarray, first: np.ndarray, sizes: np.ndarray, arrive: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(texts, SAMPLES) bytes: a hash of the characters that the output shows from the sampled step on."""
    n = len(sizes)
    steps = np.stack([r[np.maximum(np.searchsorted(r, length) - 1, 0)] for r in _records()], axis=1)
    place = np.zeros((n, SAMPLES), np.int64)
    for i in np.flatnonzero(sizes):
        place[i] = np.searchsorted(arrive[first[i] : first[i] + sizes[i]], steps[i], "right") - 1
    padded = np.concatenate([chars, np.zeros(1, np.uint32)])
    code = np.zeros((n, SAMPLES), np.uint32)
    for k in range(SPAN):
        inside = place + k < sizes[:, None]
        code = code * np.uint32(0x01000193) + np.where(inside, padded[np.where(inside, first[:, None] + place + k, len(chars))] + np.uint32(1), np.uint32(0))
    code ^= code >> np.uint32(15)
    code = code * np.uint32(0x2C1B3C6D)
    return (code >> np.uint32(24)).astype(np.uint8)


def _chars(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return chars, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), sizes


def fingerprints(texts: list[str]) -> np.ndarray:
    """(texts, SAMPLES) bytes. An empty text has the fingerprint of an output that was never written."""
    chars, first, sizes = _chars(texts)
    arrive = np.empty(len(chars), np.int64)
    return _sample(chars, first, sizes, arrive, _walk(_class(chars), first, sizes, np.zeros(len(sizes), np.int64), arrive))


def with_edits(texts: list[str], new_ends: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of texts, and of the texts whose last quarter is replaced by ``new_ends``: the walk to the edit is taken once."""
    chars, first, sizes = _chars(texts)
    classes, arrive = _class(chars), np.empty(len(chars), np.int64)
    own = _sample(chars, first, sizes, arrive, _walk(classes, first, sizes, np.zeros(len(sizes), np.int64), arrive))
    keep = sizes - sizes // 4
    tail, _, tails = _chars(new_ends)
    total = keep + tails
    begin = np.concatenate([[0], np.cumsum(total)[:-1]]).astype(np.int64)
    edited, when = np.empty(int(total.sum()), np.uint32), np.empty(int(total.sum()), np.int64)
    step, t = np.zeros(len(sizes), np.int64), 0
    stay = _stay()
    for i in range(len(sizes)):
        a, k, b = first[i], keep[i], begin[i]
        edited[b : b + k], when[b : b + k] = chars[a : a + k], arrive[a : a + k]
        edited[b + k : b + total[i]] = tail[t : t + tails[i]]
        t += tails[i]
        if k:
            last = arrive[a + k - 1]
            step[i] = last + stay[classes[a + k - 1] + (last & (PERIOD - 1))]
    length = _walk(_class(edited), begin + keep, tails, step, when)
    return own, _sample(edited, begin, total, when, length)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, 0 to 1."""
    return (a == b).mean(axis=-1)


def fingerprint(text: Column) -> Column:
    """Hex fingerprint; null counts as empty. Equal texts have equal fingerprints."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        out, held, size = [], [], 0
        for t in texts:
            held.append(t or "")
            size += len(held[-1])
            if size > 1 << 20:
                out += [f.tobytes().hex() for f in fingerprints(held)]
                held, size = [], 0
        if held:
            out += [f.tobytes().hex() for f in fingerprints(held)]
        return pd.Series(out, dtype=object)

    return of(text)


# A document and the next one ------------------------------------------------------------------


def _ranges(docs: DataFrame, id: str) -> DataFrame:
    """Documents dealt to ranges of ids, and the first of each range once more, marked ``ahead``, at the end of the range before.

    The bounds are values of the id at equal ranks, at most one for each shuffle partition. A range so knows the document after
    its last one, and nothing else is copied.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranks = [(i + 1) / (parts + 1) for i in range(parts)]
    if docs.schema[id].dataType.simpleString() == "string":  # bounds only deal the rows out, so a sample gives them
        found = docs.agg(F.min(id).alias("low"), F.count_if(F.col(id).isNull()).alias("gaps")).first()
        some = sorted(x[0] for x in bounded_sample(docs.select(id).filter(F.col(id).isNotNull()), 20_000, id).collect())
        at = [some[int(len(some) * x)] for x in ranks] if some else []
    else:
        found = docs.agg(F.min(id).alias("low"), F.percentile_approx(id, ranks, 20000).alias("cuts"), F.count_if(F.col(id).isNull()).alias("gaps")).first()
        at = found["cuts"] or []
    cuts = sorted(set(at) - {found["low"]})
    heads = ([] if found["gaps"] else [found["low"]]) + cuts
    if found["gaps"] and found["low"] is not None:
        cuts = [found["low"], *cuts]  # missing ids are a range of their own, the first
        heads = [None, *cuts]
    last = len(cuts)
    own = F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(id))), F.lit(0)) if cuts else F.lit(0)
    ahead = F.col(id).isin([h for h in heads if h is not None]) | (F.col(id).isNull() if heads[:1] == [None] or found["low"] is None else F.lit(False))
    before = F.when(F.col("own") == 0, F.lit(last)).otherwise(F.col("own") - 1)
    copies = F.when(ahead, F.array(F.struct(F.col("own").alias("range"), F.lit(0).alias("ahead")), F.struct(before.alias("range"), F.lit(1).alias("ahead")))).otherwise(
        F.array(F.struct(F.col("own").alias("range"), F.lit(0).alias("ahead")))
    )
    placed = docs.withColumn("own", own.cast("int")).select(id, "text", F.explode(copies).alias("r")).select("r.range", "r.ahead", id, "text")
    return placed.repartition("range").sortWithinPartitions("range", "ahead", F.col(id).asc_nulls_first(), "text")


def _chain(id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def rows(ranges: list, aheads: list, ids: list, texts: list[str]) -> pa.RecordBatch:
        """All rows but those that only look ahead; a row's next is the one after it in the lists."""
        ends = [texts[i + 1][: len(t) // 4] for i, t in enumerate(texts[:-1])] + [""]
        own, edited = with_edits(texts, ends)
        at = [i for i in range(len(ids) - 1) if not aheads[i]]
        sha = [hashlib.sha256((texts[i][: len(texts[i]) - len(texts[i]) // 4] + ends[i]).encode("utf-8")).hexdigest() for i in at]
        return pa.RecordBatch.from_arrays([
            pa.array([ids[i] for i in at], id_type), pa.array([len(texts[i]) for i in at], pa.int64()), pa.array(sha, pa.string()),
            pa.array([own[i].tobytes().hex() for i in at], pa.string()), pa.array([edited[i].tobytes().hex() for i in at], pa.string()),
            pa.array(likeness(own[at], edited[at]), pa.float64()), pa.array(likeness(own[at], own[[i + 1 for i in at]]), pa.float64()),
        ], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for whole in batches:
            for part in slices(whole, "text"):
                columns = [part.column(i).to_pylist() for i in range(4)]
                columns[3] = [t or "" for t in columns[3]]
                if held is not None:
                    columns = [[h, *c] for h, c in zip(held, columns)]
                yield rows(*columns)
                held = tuple(c[-1] for c in columns)

    return run


def compare_with_next(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how like it is to the edited text and to the next document.

    The edited text has its last floor(n_chars / 4) code points replaced by as many first ones of the next document in ascending
    id (or all it has); the first follows the last. One shuffle by ranges of ids brings neighbours together; a task reads
    its ranges in order and computes every fingerprint once, but for the first of each range.

    Null texts are empty. Null ids come first. Rows that repeat an id follow one another by text. A single document is its own
    next. Ids that are not int or long are compared and returned as strings. An empty table gives no rows; other columns are not read.
    """
    kind = docs.schema[id].dataType.simpleString()
    name = F.col(id) if kind in ("bigint", "int") else F.col(id).cast("string")
    kind = kind if kind in ("bigint", "int") else "string"
    rows = _ranges(docs.select(name.alias("id"), F.coalesce(text, F.lit("")).alias("text")), "id")
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    out = rows.mapInArrow(_chain(id_type), f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id)


# Near groups ----------------------------------------------------------------------------------


def near_groups(prints: DataFrame, id: str = "doc_id", fp: str = "fingerprint", bands: int = 32, least: float = 0.8) -> DataFrame:
    """Rows with component_id: the smallest id reachable through fingerprints that are at least ``least`` alike.

    Bands are runs of sampled bytes. Fingerprints that share a band are compared in full, in groups of bounded size,
    and each group gives a spanning forest. Equal fingerprints are one node, so copies make no pairs. With 32 bands of 4
    bytes, two fingerprints that are 0.8 alike share no band with probability 5e-8. Rows without a
    fingerprint keep their own id; a column named component_id is replaced.
    """
    prints = without(prints, ["component_id"], [id, fp])
    nodes = cut_lineage(prints.filter(F.col(fp).isNotNull()).groupBy(F.col(fp).alias("f")).agg(F.min(id).alias("low")))
    nodes = cut_lineage(nodes.withColumn("number", F.monotonically_increasing_id()))
    width = 2 * SAMPLES // bands
    cut = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.substr("f", b * width + 1, F.lit(width))))
    keys = nodes.select("number", F.explode(cut).alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    # Only numbers are dealt by band; the fingerprints join where a band is shared.
    dealt = deal_blocks(cut_lineage(keys.join(shared, "key")), "number", BLOCK).join(nodes.select("number", "f"), "number")

    def links(_: tuple, group: pa.Table) -> pa.Table:
        names = group.column("f").to_pylist()
        prints_ = np.frombuffer(bytes.fromhex("".join(names)), np.uint8).reshape(len(names), -1)
        pairs = forest(len(names), lambda s, e: (prints_[s:e, None] == prints_[None, :]).mean(axis=2) >= least, 16)
        return pa.table({"a": pa.array([names[i] for i, _ in pairs], pa.string()), "b": pa.array([names[j] for _, j in pairs], pa.string())})

    roots = components(dealt.groupBy("key", "p", "q").applyInArrow(links, "a string, b string").distinct())
    placed = nodes.join(roots, F.col("f") == F.col("node"), "left").withColumn("root", F.coalesce("root", "f"))
    named = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    of = placed.join(named, "root").select(F.col("f").alias(fp), "component_id")
    return prints.join(of, fp, "left").withColumn("component_id", F.coalesce("component_id", id))
