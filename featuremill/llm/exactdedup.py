"""Exact duplicates: combine in each task, then per salt, then over the salts, on full content each time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .batches import ascii_lower

SALTS = 16
_CONTENT, _DIGEST, _SALT, _BEST, _N = "__content", "__digest", "__salt", "__best", "__n"


def sha256_hex(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def _combined(rows: DataFrame, id: str, others: list[str], text: str, normal: Callable, digest: Callable) -> DataFrame:
    """One row per different content: digest, content, the row with the largest id as a struct, and the count.

    Spark combines equal (digest, content) pairs inside each task before either shuffle, and both
    groupings carry the content itself, so a digest shared by different contents never merges them.
    The salt is the number of the task's partition: a group of copies arrives spread over the salts, one row for each task.
    """
    content = rows.select(
        normal(F.col(text)).alias(_CONTENT),
        F.struct(F.col(id).alias("id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)]).alias(_BEST),
    ).withColumn(_SALT, F.spark_partition_id() % SALTS)
    content = content.withColumn(_DIGEST, digest(F.col(_CONTENT)))
    by_salt = content.groupBy(_DIGEST, _SALT, _CONTENT).agg(F.max(_BEST).alias(_BEST), F.count(F.lit(1)).alias(_N))
    # Partitioned by the digest alone, so that the contents of one digest can be counted without a third shuffle.
    placed = by_salt.drop(_SALT).repartition(F.col(_DIGEST))
    return placed.groupBy(_DIGEST, _CONTENT).agg(F.max(_BEST).alias(_BEST), F.sum(_N).alias(_N))


def keep_winners(docs: DataFrame, text: str = "text", id: str = "doc_id", normal: Callable = ascii_lower, digest: Callable = sha256_hex) -> DataFrame:
    """One whole row per different text: the one with the largest id, its own columns and spelling unchanged.

    Null texts are one group with the empty text. Null ids count as smallest. Rows equal in text and id
    leave one row (the largest by the other columns). Columns must be orderable; an empty table stays empty.
    """
    others = [c for c in docs.columns if c != id]
    best = _combined(docs, id, others, text, normal, digest)
    names = {id: "id"} | {c: f"c{i}" for i, c in enumerate(others)}
    return best.select(*[F.col(_BEST)[names[c]].alias(c) for c in docs.columns])


def decide(docs: DataFrame, text: str = "text", id: str = "doc_id", normal: Callable = ascii_lower, digest: Callable = sha256_hex) -> DataFrame:
    """(id, digest, keep_id, group_size, kept), one row per document, dropped ones included.

    Rows that repeat both id and text are counted in group_size, and exactly one of them is kept. Null
    ids count as smallest. The combined groups are stored without their contents; a digest that stands
    for two contents keeps them, and its documents are then matched by content.
    """
    groups = _combined(docs, id, [], text, normal, digest)
    table = groups.groupBy(_DIGEST).agg(F.collect_list(F.struct(F.col(_BEST)["id"].alias("keep_id"), F.col(_N).alias("n"), F.col(_CONTENT).alias("content"))).alias("variants"))
    clash = F.size("variants") > 1
    table = cut_lineage(table.select(_DIGEST, F.explode(F.transform("variants", lambda v: F.struct(v["keep_id"].alias("keep_id"), v["n"].alias("n"), F.when(clash, v["content"]).alias("content")))).alias("v")).select(_DIGEST, "v.*"))
    clashes = cut_lineage(table.filter(F.col("content").isNotNull()))
    narrow = docs.select(F.col(id).alias("__id"), digest(normal(F.col(text))).alias(_DIGEST))
    plain = narrow.groupBy("__id", _DIGEST).agg(F.count(F.lit(1)).alias("__m"))
    single = plain.join(table.filter(F.col("content").isNull()).drop("content"), _DIGEST)
    content = docs.select(F.col(id).alias("__id"), normal(F.col(text)).alias("content")).withColumn(_DIGEST, digest(F.col("content")))
    several = content.join(clashes, [_DIGEST, "content"]).groupBy("__id", _DIGEST, "keep_id", "n").agg(F.count(F.lit(1)).alias("__m"))
    both = single.select("__id", _DIGEST, "keep_id", "n", "__m").unionByName(several)
    copy = both.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__m").cast("int"))))
    return copy.select(
        F.col("__id").alias(id), F.col(_DIGEST).alias("digest"), "keep_id", F.col("n").alias("group_size"),
        (F.col("__id").eqNullSafe(F.col("keep_id")) & (F.col("__copy") == 1)).alias("kept"),
    )
