"""Reconciling identifiers with a legend, chaining bridge tables, and comparing annotation sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import remove_first
from .aggregate import count_rows
from .joins import first_per_key, keep_in, keep_not_in, null_safe_join, open_left_join
from .ordered import row_rank
from .setops import stack, two_way_difference

BOTH, ID_ONLY, SYMBOL_ONLY, NONE = "id_and_symbol", "id_only", "symbol_only", "none"


def reconcile_ids(items: DataFrame, legend: DataFrame, first_symbol_match: bool = True) -> DataFrame:
    """items(id, symbol) against legend(ext_id, ext_symbol): both keys, else id, else symbol, else none.

    One linear chain of left joins. A row that an earlier tier has matched carries a missing key
    into the later joins, so tiers never multiply each other and nothing is scanned twice.
    """
    items = items.select("id", "symbol").distinct()
    legend = legend.select("ext_id", "ext_symbol").filter(F.col("ext_id").isNotNull() | F.col("ext_symbol").isNotNull()).distinct()
    pairs = legend.filter(F.col("ext_id").isNotNull() & F.col("ext_symbol").isNotNull()).select(
        F.col("ext_id").alias("id"), F.col("ext_symbol").alias("symbol"), F.lit(True).alias("__both")
    )
    by_id = legend.select(F.col("ext_id").alias("__k1"), F.struct("ext_id", "ext_symbol").alias("__m1"))
    by_symbol = legend.filter(F.col("ext_symbol").isNotNull())
    if first_symbol_match:
        by_symbol = first_per_key(by_symbol, ["ext_symbol"], ["ext_id"])
    by_symbol = by_symbol.select(F.col("ext_symbol").alias("__k2"), F.struct("ext_id", "ext_symbol").alias("__m2"))

    step = items.join(pairs, ["id", "symbol"], "left")
    step = step.withColumn("__k1", F.when(F.col("__both").isNull(), F.col("id")))
    step = open_left_join(step, by_id, "__k1")
    open_row = F.col("__both").isNull() & F.col("__m1").isNull()
    step = open_left_join(step.withColumn("__k2", F.when(open_row, F.col("symbol"))), by_symbol, "__k2")
    tier = (
        F.when(F.col("__both"), BOTH)
        .when(F.col("__m1").isNotNull(), ID_ONLY)
        .when(F.col("__m2").isNotNull(), SYMBOL_ONLY)
        .otherwise(NONE)
    )
    own = F.when(F.col("__both"), F.struct(F.col("id").alias("ext_id"), F.col("symbol").alias("ext_symbol")))
    match = F.coalesce(own, F.col("__m1"), F.col("__m2"), F.struct(F.col("id").alias("ext_id"), F.col("symbol").alias("ext_symbol")))
    return step.select("id", "symbol", match["ext_id"].alias("ext_id"), match["ext_symbol"].alias("ext_symbol"), tier.alias("tier"))


def annotate_many(items: DataFrame, *bridges: tuple[DataFrame, str, str]) -> DataFrame:
    """Chain of left joins; each bridge is (table, key column, joined-on column of the chain).

    Blank join keys count as missing, and a missing key stays unannotated.
    """
    out = items
    for table, key, on in bridges:
        # Text keys may hold blanks in place of a missing value.
        right_key = F.nullif(F.col(key), F.lit("")) if dict(table.dtypes)[key] == "string" else F.col(key)
        right = table.withColumn("__key", right_key).filter(F.col("__key").isNotNull())
        right = right.drop(key).distinct()
        left_key = F.nullif(F.col(on), F.lit("")) if dict(out.dtypes)[on] == "string" else F.col(on)
        out = out.withColumn("__key", left_key).join(right, "__key", "left").drop("__key")
    return out


def merge_sources(items: DataFrame, a: DataFrame, b: DataFrame, codes: dict[str, str] | None = None) -> DataFrame:
    """Two (id, term, name, source) tables to one, codes harmonised, rejoined to every item."""
    both = stack(a, b)
    if codes:
        from ..functions.text import recode

        both = recode(both, "source", codes)
    return items.select("id").distinct().join(both.na.drop("any").distinct(), "id", "left")


def coverage(items: DataFrame, annotation: DataFrame, hits: DataFrame) -> DataFrame:
    """Items, items without annotation, and hits among the latter, as one row."""
    known = annotation.select("id").distinct().withColumn("__a", F.lit(True))
    hit = hits.select("id").distinct().withColumn("__h", F.lit(True))
    flags = items.select("id").distinct().join(known, "id", "left").join(hit, "id", "left")
    bare = F.col("__a").isNull()
    return flags.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(bare).alias("unannotated"),
        F.count_if(bare & F.col("__h")).alias("unannotated_hits"),
    )


def unannotated(items: DataFrame, annotation: DataFrame) -> DataFrame:
    return keep_not_in(items, "id", annotation, "id")


def source_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, term) pairs known to one source only; missing parts are dropped first."""
    return two_way_difference(a.select("id", "term").na.drop("any"), b.select("id", "term").na.drop("any"), ["id", "term"])


def term_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    return two_way_difference(a.select("term").na.drop(), b.select("term").na.drop(), ["term"])


def clean_prefix(df: DataFrame, col: str, text: str) -> DataFrame:
    """Strip a literal leading text such as a database tag."""
    return df.withColumn(col, remove_first(F.col(col), text))


def build_annotation_table(*sources: tuple[DataFrame, str]) -> DataFrame:
    """(gene, term, name) tables with a database name each, to one schema; blanks and missing rows dropped."""
    parts = [
        t.select(
            F.col("gene").cast("string").alias("gene"),
            F.nullif(F.col("term").cast("string"), F.lit("")).alias("term"),
            F.col("name").cast("string").alias("name"),
            F.lit(db).alias("db"),
        )
        for t, db in sources
    ]
    return stack(*parts).filter(F.col("gene").isNotNull() & F.col("term").isNotNull()).distinct()


def reference_set(detected: DataFrame, annotation: DataFrame) -> DataFrame:
    """Background: detected genes that carry an annotation."""
    return keep_in(detected.select("gene").distinct(), "gene", annotation, "gene")


def ranked_list(tests: DataFrame, reference: DataFrame, by: str = "padj") -> DataFrame:
    """Background genes in test order: (gene, rank), a missing value last, ties by gene."""
    kept = keep_in(tests.select("gene", by), "gene", reference, "gene")
    return row_rank(kept, [by, "gene"], "rank").select("gene", "rank")


def match_counts(items: DataFrame, legend: DataFrame) -> DataFrame:
    """How many items each tier of :func:`reconcile_ids` resolved."""
    return count_rows(reconcile_ids(items, legend).select("id", "symbol", "tier").distinct(), "tier")


def full_outer(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return null_safe_join(left, right, keys, "full")
