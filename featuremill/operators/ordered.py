"""Order-dependent results (ranks, running sums, exact quantiles) without a one-task sort.

Rows are range-partitioned on (keys, order) and stored once, each task scans its own range, and
the carry between ranges comes from one row per (range, key). Because ranges cut through a key, a
key that holds a third of all rows is spread over a third of the tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import null_safe_join

_RANGE = "__range"


def _directed(order: list[str], descending: bool) -> list[Column]:
    return [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in order]


def store_by_range(df: DataFrame, keys: list[str], order: list[str], descending: list[str] | None = None) -> DataFrame:
    """Range-partition, tag each row with its range number, and store.

    The stored copy is what makes the tag trustworthy: range bounds are sampled, so a recomputed
    shuffle could place a row elsewhere. The number of ranges is left to adaptive execution, which
    merges neighbouring small ranges and so keeps their order.
    """
    down = set(descending or [])
    cols = [F.col(c).desc_nulls_last() if c in down else F.col(c).asc_nulls_last() for c in [*keys, *order]]
    return cut_lineage(df.repartitionByRange(*cols).withColumn(_RANGE, F.spark_partition_id()))


def _carry(stored: DataFrame, keys: list[str], aggs: dict[str, Column], fold: Callable, backwards: bool) -> DataFrame:
    """Fold of the aggregates over all earlier (or later) ranges of the same key."""
    per_range = stored.groupBy(_RANGE, *keys).agg(*[c.alias(a) for a, c in aggs.items()])
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col(_RANGE).desc() if backwards else F.col(_RANGE))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return per_range.select(_RANGE, *keys, *[fold(F.col(a)).over(before).alias(a) for a in aggs])


def _attach(stored: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    return null_safe_join(stored, carry, [_RANGE, *keys])


def running_sum(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], stored: bool = False) -> DataFrame:
    """Running totals within keys. ``sums`` maps output name to input column.

    (keys, order) must be unique; aggregate ties first, which also takes hot values off the wire.
    """
    base = df if stored else store_by_range(df, keys, order)
    carry = _carry(base, keys, {f"__c_{o}": F.sum(c) for o, c in sums.items()}, F.sum, backwards=False)
    w = Window.partitionBy(_RANGE, *keys).orderBy(*_directed(order, False)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    out = _attach(base, carry, keys).withColumns(
        {o: F.sum(c).over(w) + F.coalesce(F.col(f"__c_{o}"), F.lit(0)) for o, c in sums.items()}
    )
    return out.drop(*[f"__c_{o}" for o in sums])


def following_min(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Minimum of ``value`` over this row and all later ones; ``df`` must carry range tags."""
    carry = _carry(df, keys, {"__later": F.min(value)}, F.min, backwards=True)
    w = Window.partitionBy(_RANGE, *keys).orderBy(*_directed(order, True)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return _attach(df, carry, keys).withColumn(out, F.least(F.min(value).over(w), F.col("__later"))).drop("__later")


def row_rank(
    df: DataFrame, order: list[str], out: str = "rank", descending: list[str] | None = None, keys: list[str] | None = None
) -> DataFrame:
    """Unique 1-based position in the total order (missing values last), within keys if given.

    ``order`` must end in a unique column so that the position is well defined.
    """
    keys = keys or []
    down = set(descending or [])
    cols = [F.col(c).desc_nulls_last() if c in down else F.col(c).asc_nulls_last() for c in order]
    base = store_by_range(df, keys, order, descending)
    carry = _carry(base, keys, {"__before": F.count(F.lit(1))}, F.sum, backwards=False)
    w = Window.partitionBy(_RANGE, *keys).orderBy(*cols)
    return (
        _attach(base, carry, keys)
        .withColumn(out, (F.row_number().over(w) + F.coalesce(F.col("__before"), F.lit(0))).cast("long"))
        .drop("__before", _RANGE)
    )


def ntile(df: DataFrame, order: list[str], tiles: int, out: str = "tile") -> DataFrame:
    """Equal-sized tiles of the total order; the first (n mod tiles) tiles hold one row more."""
    ranked = row_rank(df, order, "__pos")
    n = df.groupBy().agg(F.count(F.lit(1)).alias("n")).scalar()
    size, extra = F.floor(n / tiles), n % tiles
    edge = extra * (size + 1)
    pos = F.col("__pos") - 1
    tile = F.when(pos < edge, F.floor(pos / (size + 1))).otherwise(
        extra + F.floor((pos - edge) / F.greatest(size, F.lit(1)))
    )
    return ranked.withColumn(out, (tile + 1).cast("int")).drop("__pos")


def quantiles_by(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per key (missing values skipped), one row per key.

    Equal values are counted first and the counts run up in order, so neither a hot key nor a hot
    value gathers in one task.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    up = running_sum(counts, keys, [value], {"__upto": "__n"})
    total = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    joined = up.join(total, keys) if keys else up.withColumn("__total", total.scalar())
    exprs = []
    for name, q in probs.items():
        h = (F.col("__total") - 1) * q
        low = F.min(F.when(F.col("__upto") >= F.floor(h) + 1, F.col(value)))
        high = F.min(F.when(F.col("__upto") >= F.ceil(h) + 1, F.col(value)))
        exprs.append((low + (high - low) * F.max(h - F.floor(h))).alias(name))
    return joined.groupBy(*keys).agg(*exprs)


def median_by(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    return quantiles_by(df, keys, value, {out: 0.5})


def mad_by(df: DataFrame, keys: list[str], value: str, out: str = "mad", scale: float = 1.4826) -> DataFrame:
    """Median absolute deviation, scaled to match a normal standard deviation."""
    med = median_by(df, keys, value, "__med")
    if keys:
        dev = df.join(med, keys)
    else:
        dev = df.withColumn("__med", med.scalar())
    dev = dev.select(*keys, F.abs(F.col(value) - F.col("__med")).alias("__dev"))
    return median_by(dev, keys, "__dev", out).withColumn(out, F.col(out) * scale)


def top_and_rest(df: DataFrame, value: str, k: int, largest: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows whose value is among the k best (all ties kept), and all other rows, missing values included.

    Each task keeps its k best values, the merged k-th value becomes a filter. The rows are stored
    first: a value recomputed in another summation order could miss its own threshold.
    """
    stored = cut_lineage(df)
    order = F.col(value).desc() if largest else F.col(value).asc()
    best = stored.filter(F.col(value).isNotNull()).select(value).orderBy(order).limit(k)
    limit = best.agg((F.min if largest else F.max)(value).alias("t")).scalar()
    hit = F.col(value) >= limit if largest else F.col(value) <= limit
    return stored.filter(hit), stored.filter(~F.coalesce(hit, F.lit(False)))


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows of a stated order; each task keeps n, and the merge keeps n."""
    return df.orderBy(*_directed(order, False)).limit(n)


def unequal_positions(left: DataFrame, right: DataFrame, col: str, left_order: list[str], right_order: list[str]) -> DataFrame:
    """(rank, left, right) where two columns, each in its own order, differ; a shorter one differs at its end."""
    a = row_rank(left, left_order, "rank").select("rank", F.col(col).alias("left"))
    b = row_rank(right, right_order, "rank").select("rank", F.col(col).alias("right"))
    return a.join(b, "rank", "full").filter(~F.col("left").eqNullSafe(F.col("right")))


def top_with_ties(df: DataFrame, value: str, k: int, largest: bool = True) -> DataFrame:
    return top_and_rest(df, value, k, largest)[0]


def rest_after_top(df: DataFrame, value: str, k: int, largest: bool = True) -> DataFrame:
    return top_and_rest(df, value, k, largest)[1]


def top_per_key(df: DataFrame, keys: list[str], value: str, k: int, largest: bool = True) -> DataFrame:
    """Top-k with ties inside each key. Spark trims each task to the k best ranks before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last() if largest else F.col(value).asc_nulls_last())
    return df.withColumn("__r", F.rank().over(w)).filter(F.col("__r") <= k).drop("__r")
