"""Links inside groups that share a key, without all pairs and without a whole hot group in one task; connected components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, release


def forest(n: int, close: Callable[[int, int], np.ndarray], rows: int = 256) -> list[tuple[int, int]]:
    """(member, smallest member of its component) of one group. ``close(s, e)`` says which members each of s..e-1 links to."""
    label = np.arange(n)
    while True:
        best = label.copy()
        for s in range(0, n, rows):
            e = min(n, s + rows)
            best[s:e] = np.where(close(s, e), label[None, :], n).min(axis=1)
        best = best[best]
        if (best == label).all():
            return [(i, int(r)) for i, r in enumerate(label) if i != r]
        label = best


def deal_blocks(keys: DataFrame, member: str, block: int) -> DataFrame:
    """(key, p, q, member): keys with more than ``block`` members are dealt by pairs of blocks, so every two members of a key
    still meet in some (key, p, q), and none of these has many more than twice ``block`` members."""
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    hot = cut_lineage(sizes.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64(member), F.col("blocks")).cast("int")
    pair = lambda b: F.struct(F.least(b, own).alias("p"), F.greatest(b, own).alias("q"))
    pairs = F.when(F.col("blocks").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair)).otherwise(
        F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q")))
    )
    return keys.join(hot, "key", "left").select("key", F.explode(pairs).alias("pq"), member).select("key", "pq.p", "pq.q", member)


#: Neighbours of a node that one task meets with the smallest of them.
LEAVES = 512


def components(links: DataFrame, leaves: int = LEAVES) -> DataFrame:
    """(node, root): the smallest node of each connected component with at least one link.

    Large-star and small-star rounds until the links no longer change. A node with more than ``leaves`` neighbours has them dealt over as many
    salts as needed. Each round is stored, and the one before it removed; only a count and a checksum reach the driver.
    """
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), F.ceil(F.col("n") / leaves).cast("int").alias("salts")))
        hubs = cut_lineage(least.filter("salts > 1").select("u", "salts"))
        one = F.lit(1)
        dealt = both.join(hubs, "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), F.coalesce("salts", one)).cast("int").alias("salt"))
        each = least.select("u", "m", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        large = dealt.join(each, ["u", "salt"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, cut_lineage(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        for table in (old, least, hubs):
            release(table)
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
