"""Shards by jump consistent hashing (Lamping and Veach): no ring table, and only the necessary moves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import row_rank
from .batches import without

# Fixed values of the published generator.
MULTIPLIER = np.uint64(2862933555777941757)
SPAN = float(1 << 31)


def jump(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit hash. A key jumps forward about ln(shards) times; finished keys drop out of the loop."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = hashes.astype(np.uint64)
    shard = np.zeros(len(state), dtype=np.int64)
    live, here = np.arange(len(state)), np.zeros(len(state), dtype=np.int64)
    with np.errstate(over="ignore"):
        while live.size:
            shard[live] = here
            state = state * MULTIPLIER + np.uint64(1)
            drawn = (state >> np.uint64(33)).astype(np.float64) + 1.0
            here = np.floor((here + 1) * (SPAN / drawn)).astype(np.int64)
            on = here < shards
            live, here, state = live[on], here[on], state[on]
    return shard.astype(np.int32)


def shard_of(shards: int, *keys: Column | str) -> Column:
    """Shard number from the hash of the key columns. Null keys hash like any value, so they share a shard."""

    @F.pandas_udf("int")
    def number(h: pd.Series) -> pd.Series:
        return pd.Series(jump(h.to_numpy(np.int64).view(np.uint64), shards))

    return number(F.xxhash64(*keys))


def assign_shards(rows: DataFrame, keys: list[str], shards: int, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Every row with its shard and its gapless place in the shard, counted from 0 in key order.

    The shard depends on the keys and the number of shards alone, so appending a shard moves rows into
    the new one only. Places come from ranges of (shard, keys) and one count per range, so a shard is
    never sorted in one task. Null keys are a value of their own and come last; rows that repeat a key get
    neighbouring places in any order; an empty table gives no rows; other columns pass through, but those named like the two made here are replaced.
    """
    rows = without(rows, [shard, slot], keys)
    placed = rows.withColumn(shard, shard_of(shards, *keys))
    return row_rank(placed, keys, slot, keys=[shard]).withColumn(slot, F.col(slot) - 1)


def write_shards(rows: DataFrame, keys: list[str], shards: int, folder: str) -> None:
    """One folder of Parquet files per shard. Each task writes what it holds, so a large shard is written by many."""
    rows.withColumn("shard", shard_of(shards, *keys)).write.partitionBy("shard").parquet(folder)
