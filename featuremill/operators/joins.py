"""Equi-joins with stated rules for missing keys, duplicates and column collisions.

No join here asks for a broadcast: Spark broadcasts a side when its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and otherwise sort-merges, splitting skewed partitions.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", dealt: bool = False) -> DataFrame:
    """Join in which a missing key matches a missing key. Key columns appear once in the result.

    A full join is made of a left join and the rows of the right side that it misses (:func:`full_join`). ``dealt`` is for sides that both
    repeat their keys (:func:`dealt_join`).
    """
    if how in ("left_semi", "left_anti"):
        r = right.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
        cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
        return left.join(r, cond, how)
    if how == "full":
        return full_join(left, right, keys, dealt)
    if dealt and how in ("inner", "left"):
        return dealt_join(left, right, keys, how)
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys}).withColumn("__in_right", F.lit(True))
    l = left.withColumn("__in_left", F.lit(True)) if how == "right" else left
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    joined = l.join(renamed, cond, how)
    if how == "right":
        joined = joined.withColumns(
            {k: F.when(F.col("__in_left"), F.col(k)).otherwise(F.col(f"__{k}")) for k in keys}
        )
    return joined.drop("__in_right", "__in_left", *[f"__{k}" for k in keys])


#: Rows that a key may give before it is cut into shares of about so many, fewest left rows of a share, and rows that a task gives.
SHARE, LEAST, TASK_ROWS = 1 << 20, 64, 1 << 23


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", share: int = SHARE) -> DataFrame:
    """Inner or left join on null-safe keys that many rows of both sides have in common.

    The planner sees how many bytes go into a join, not how many rows come out. Here the rows of both sides are counted by key first. A key that gives more than
    ``share`` rows has its left rows cut into shares, each of which meets all right rows of the key, and there are as many tasks as the result needs.
    """
    n = F.count(F.lit(1))
    sizes = cut_lineage(null_safe_join(left.groupBy(*keys).agg(n.alias("__l")), right.groupBy(*keys).agg(n.alias("__r")), keys))
    rows = sizes.withColumn("__n", F.col("__l").cast("double") * F.col("__r"))
    hot = rows.filter(F.col("__n") > share).select(*keys, F.ceil(F.least(F.col("__n") / share, F.col("__l") / LEAST)).cast("int").alias("__shares"))
    total = rows.agg(F.sum("__n").alias("n"), F.count_if(F.col("__n") > share).alias("hot")).first()
    if not total.hot:
        return null_safe_join(left, right, keys, how)
    one = F.coalesce("__shares", F.lit(1))
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total.n / TASK_ROWS))
    cell = lambda s: F.struct(*keys, s.alias("__share"))  # noqa: E731  missing fields of a struct equal one another
    l = null_safe_join(left, hot, keys, "left").withColumn("__cell", cell(F.pmod(F.xxhash64(*left.columns), one).cast("int"))).drop("__shares")
    r = null_safe_join(right, hot, keys, "left").withColumn("__s", F.explode(F.sequence(F.lit(0), one - 1)))
    r = r.withColumn("__cell", cell(F.col("__s"))).drop(*keys, "__shares", "__s")
    # Sorted and merged: the planner takes the dealt rows for as few as they were, and would broadcast them.
    return l.repartition(tasks, "__cell").join(r.repartition(tasks, "__cell").hint("merge"), "__cell", how).drop("__cell")


def open_left_join(left: DataFrame, right: DataFrame, key: str, spread: int = 256) -> DataFrame:
    """Left join in which a missing key matches nothing. Rows without a key are spread over ``spread`` key values that the
    right side lacks, so that they do not meet in one task."""
    salt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*left.columns), F.lit(spread)) + 1).otherwise(F.lit(0).cast("long"))
    zero = F.pmod(F.xxhash64(key), F.lit(1))  # always 0; a literal would be folded out of the join keys
    return left.withColumn("__salt", salt).join(right.withColumn("__salt", zero), [key, "__salt"], "left").drop("__salt")


def full_join(left: DataFrame, right: DataFrame, keys: list[str], dealt: bool = False) -> DataFrame:
    """Full join on null-safe keys as a left join and the rows of the right side that it misses.

    Spark can split the partitions of hot keys in both, which it cannot in a full join.
    """
    alone = null_safe_join(right, left.select(*keys), keys, "left_anti")
    return null_safe_join(left, right, keys, "left", dealt).unionByName(alone, allowMissingColumns=True)


#: Members of a key up to which one task makes all its pairs.
HUB = 256


def pairs_of_members(rows: DataFrame, key: str, member: str, carry: list[str] | None = None, hub: int = HUB) -> DataFrame:
    """(key, a, b, and each carried column as ``name_a`` and ``name_b``): every two members a < b of a key, whose rows are unique.

    A key with more than ``hub`` members has them cut into blocks, and each pair of blocks is a key of its own, so no task makes all pairs of a
    hub. Missing keys and members make no pairs.
    """
    carry = carry or []
    rows = rows.select(F.col(key).alias("__key"), F.col(member).alias("__m"), *carry).filter("__key IS NOT NULL AND __m IS NOT NULL")
    hubs = cut_lineage(rows.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hub).select("__key", F.ceil(F.col("n") / hub).cast("int").alias("blocks")))
    n = F.coalesce("blocks", F.lit(1))
    dealt = rows.join(hubs, "__key", "left").withColumn("__own", F.pmod(F.xxhash64("__m"), n).cast("int"))

    def side(name: str, other: Column) -> DataFrame:
        own, met = ("__p", "__q") if name == "a" else ("__q", "__p")
        return dealt.select("__key", F.col("__own").alias(own), F.explode(other).alias(met), F.col("__m").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in carry])

    left, right = side("a", F.sequence(F.col("__own"), n - 1)), side("b", F.sequence(F.lit(0), F.col("__own")))
    met = left.join(right, ["__key", "__p", "__q"]).filter((F.col("__p") != F.col("__q")) | (F.col("a") < F.col("b"))).filter("a <> b")
    # Members of two blocks meet once, in either order.
    turned = F.col("a") > F.col("b")
    swap = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x)
    both = [c for name in ["", *[f"{c}_" for c in carry]] for c in (swap(f"{name}a", f"{name}b"), swap(f"{name}b", f"{name}a"))]
    return met.select(F.col("__key").alias(key), *both)


def keep_in(df: DataFrame, col: str, other: DataFrame, other_col: str) -> DataFrame:
    """Rows whose value occurs in the other table's column; a missing value matches a missing value."""
    return null_safe_join(df, other.select(F.col(other_col).alias(col)), [col], "left_semi")


def keep_not_in(df: DataFrame, col: str, other: DataFrame, other_col: str) -> DataFrame:
    """Complement of :func:`keep_in`; rows with a missing value stay unless the other column has one."""
    return null_safe_join(df, other.select(F.col(other_col).alias(col)), [col], "left_anti")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the smallest by ``order``, missing values last.

    Written as an aggregate (min of a struct) so each map task sends one row per key, which a
    ``row_number`` window would not do for a hot key.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = [x for c in order for x in (F.col(c).isNull().alias(f"__no_{c}"), F.col(c))]
    packed = F.struct(*ranked, *[c for c in rest if c not in order])
    return (
        df.groupBy(*keys)
        .agg(F.min(packed).alias("__first"))
        .select(*keys, *[F.col(f"__first.{c}").alias(c) for c in rest])
    )


def first_match_join(
    left: DataFrame, right: DataFrame, keys: list[str], order: list[str], how: str = "inner"
) -> DataFrame:
    """Join that keeps the smallest right-hand match per key."""
    return left.join(first_per_key(right, keys, order), keys, how)


def join_renamed(
    left: DataFrame, right: DataFrame, pairs: dict[str, str], how: str = "inner", suffix: str = "_y"
) -> DataFrame:
    """Join on differently named keys; colliding right-hand columns get the suffix."""
    drop = list(pairs.values())
    clash = {c: c + suffix for c in right.columns if c in left.columns and c not in drop}
    r = right.withColumnsRenamed({**clash, **{k: f"__{k}" for k in drop}})
    cond = reduce(lambda a, b: a & b, [F.col(a) == F.col(f"__{b}") for a, b in pairs.items()])
    return left.join(r, cond, how).drop(*[f"__{k}" for k in drop])


def guard_unique(df: DataFrame, keys: list[str], what: str = "key") -> DataFrame:
    """Pass rows through; fail the job when a key occurs twice."""
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    return df.withColumn("__n", F.when(n > 1, F.raise_error(F.lit(f"duplicate {what}"))).otherwise(n)).filter(
        F.col("__n") == 1
    ).drop("__n")


def bind_columns(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Side-by-side tables, matched by key instead of by row position."""
    return left.join(right, keys, "inner")
