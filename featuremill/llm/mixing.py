"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

import re
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import null_safe_join
from ..operators.ordered import row_rank
from ..session import cut_lineage
from .batches import WORD, without

#: Hash cells hold about so many documents; the cell a source's cut falls into is the only one that is sorted.
ROWS_PER_CELL = 2000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weigh_in_turn(sizes: DataFrame, weights: list[int]) -> DataFrame:
    """Sources in code-point order (null last) with weights that repeat."""
    ranked = row_rank(sizes, ["source"], "__rank")
    turn = F.array(*[F.lit(w).cast("long") for w in weights])
    return ranked.select("source", "size", turn[((F.col("__rank") - 1) % len(weights)).cast("int")].alias("weight"))


def water_fill(sources: DataFrame, share: tuple[int, int] = (3, 2), epochs: int = 2) -> DataFrame:
    """(source, size, target): share[0]/share[1] of all sizes dealt by weight, no source above epochs times its size.

    Sources above their cap are clamped and the rest is dealt again until none is above. A round is one
    sum over the sources, and its two whole numbers are all that reaches the driver. Sums stay whole
    until one division, so reruns agree to the bit. If the caps hold less than the total, all are full.
    """
    cap, weight, (top, bottom) = F.col("size") * epochs, F.col("weight"), share
    total = (sources.agg(F.sum("size")).first()[0] or 0) * top
    above, clamped = F.lit(False), -1
    while True:
        s = sources.agg(F.sum(F.when(above, cap)).alias("full"), F.sum(F.when(~above, weight)).alias("open"), F.count_if(above).alias("n")).first()
        if not s["open"]:
            return sources.select("source", "size", cap.cast("double").alias("target"))
        level = total - bottom * (s["full"] or 0)
        if s["n"] == clamped:
            dealt = F.lit(float(level)) / F.lit(float(bottom)) * weight.cast("double") / F.lit(float(s["open"]))
            return sources.select("source", "size", F.when(above, cap.cast("double")).otherwise(dealt).alias("target"))
        clamped = s["n"]
        above = weight.cast("decimal(12,0)") * F.lit(level).cast("decimal(24,0)") > cap.cast("decimal(20,0)") * F.lit(s["open"] * bottom).cast("decimal(16,0)")


def mix(docs: DataFrame, size: str, id: str = "doc_id", source: str = "source", weights: list[int] | None = None, share: tuple[int, int] = (3, 2), epochs: int = 2, seed: int = 0) -> DataFrame:
    """Documents with source_size, target (of their source) and taken (units of ``size`` the mix takes, repeats counted).

    Every document of a source is taken target // source_size times as a whole. The rest of the target
    goes to documents in the order of a seeded hash of the id, each once more as a whole, until the last one is
    taken in part. So a source's sum is its target rounded down, and none exceeds ``epochs`` times its
    size. The cut is found from sums per hash cell, and only the cell with the cut is sorted.

    A null source is a source. Sizes of zero take nothing. Rows that repeat an id share a hash and are told apart by
    size; equal ones are interchangeable. An empty table gives no rows; other columns pass through, but those named like the three made here are replaced.
    """
    docs = without(docs, ["source_size", "target", "taken"], [size, id, source])
    rows = docs.withColumn("__size", F.col(size).cast("long"))
    sizes = cut_lineage(rows.groupBy(F.col(source).alias("source")).agg(F.sum("__size").alias("size"), F.count(F.lit(1)).alias("__rows")))
    weighed = cut_lineage(weigh_in_turn(sizes.select("source", "size"), weights or [5, 2, 1]))
    targets = null_safe_join(water_fill(weighed, share, epochs), sizes.select("source", "__rows"), ["source"])
    whole = F.when(F.col("size") > 0, F.floor(F.floor("target") / F.col("size"))).otherwise(F.lit(0)).cast("long")
    plan = cut_lineage(
        targets.withColumn("__whole", whole)
        .withColumn("__rest", F.floor("target").cast("long") - F.col("__whole") * F.col("size"))
        .withColumn("__cells", F.ceil(F.col("__rows") / ROWS_PER_CELL).cast("long"))
        .select(F.col("source").alias(source), F.col("size").alias("source_size"), "target", "__whole", "__rest", "__cells")
    )
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id).cast("string"), F.lit(""))))
    keyed = null_safe_join(rows.withColumn("__order", digest), plan, [source])
    # 32 leading bits of the digest, cut into equal cells: a cell comes before another in digest order too.
    lead = F.conv(F.substring("__order", 1, 8), 16, 10).cast("long")
    keyed = keyed.withColumn("__cell", F.floor(lead * F.col("__cells") / F.lit(float(1 << 32))).cast("long"))
    cells = keyed.groupBy(source, "__cell").agg(F.sum("__size").alias("__sum"), F.first("__rest").alias("__rest"))
    up = Window.partitionBy(source).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__before", F.coalesce(F.sum("__sum").over(up), F.lit(0)))
    cut = cut_lineage(cells.filter((F.col("__before") <= F.col("__rest")) & (F.col("__before") + F.col("__sum") > F.col("__rest"))).select(source, F.col("__cell").alias("__cut"), "__before"))
    marked = null_safe_join(keyed, cut, [source], "left")
    in_cut = F.col("__cell") == F.col("__cut")
    # Above the cut nothing more, below it one more whole copy; without a cut the whole source fits.
    extra = F.when(F.col("__cut").isNull() | (F.col("__cell") < F.col("__cut")), F.col("__size")).otherwise(F.lit(0))
    plain = marked.filter(~F.coalesce(in_cut, F.lit(False))).withColumn("__extra", extra)
    inside = Window.partitionBy(source).orderBy("__order", F.col("__size")).rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("__rest") - F.col("__before") - F.coalesce(F.sum("__size").over(inside), F.lit(0))
    split = marked.filter(in_cut).withColumn("__extra", F.greatest(F.lit(0), F.least(F.col("__size"), room)))
    taken = (F.col("__whole") * F.col("__size") + F.col("__extra")).cast("long")
    return plain.unionByName(split).select(*docs.columns, "source_size", "target", taken.alias("taken"))


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its ``words``-th word. Rows that keep their whole text should pass null."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for t, k in zip(texts, counts):
            ends = islice(re.finditer(WORD, t), int(k) - 1, None) if t is not None and k > 0 else iter(())
            last = next(ends, None)
            out.append(t[: last.end()] if last else None if t is None else "")
        return pd.Series(out, dtype=object)

    return cut(text, words)


def repeat_mixed(mixed: DataFrame, size: str, text: str = "text", n_chars: str | None = None) -> DataFrame:
    """The mix itself: a document once for each whole time it is taken, and its first words for a part, with ``n_chars`` of that part."""
    whole = F.when(F.col(size) > 0, F.floor(F.col("taken") / F.col(size))).otherwise(F.lit(0)).cast("int")
    left = F.col("taken") - whole * F.col(size)
    times = F.concat(F.array_repeat(F.lit(0).cast("long"), whole), F.when(left > 0, F.array(left)).otherwise(F.array().cast("array<bigint>")))
    copies = mixed.withColumn("__part", F.explode(times))
    part = F.col("__part")
    out = copies.withColumn(text, F.when(part > 0, first_words(F.when(part > 0, F.col(text)), part)).otherwise(F.col(text)))
    if n_chars:
        out = out.withColumn(n_chars, F.when(part > 0, F.char_length(text).cast(mixed.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    return out.drop("__part")
