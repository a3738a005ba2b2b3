"""Text helpers on columns; all of them stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_all(col: Column, pattern: str, repl: str) -> Column:
    return F.regexp_replace(col, pattern, repl)


def replace_first(col: Column, pattern: str, repl: str) -> Column:
    """First match only. Groups in ``repl`` count from $2, because $1 is the text before the match."""
    return F.regexp_replace(col, f"^([\\s\\S]*?){pattern}", "$1" + repl)


def remove_all(col: Column, pattern: str) -> Column:
    return F.regexp_replace(col, pattern, "")


def remove_first(col: Column, pattern: str) -> Column:
    return replace_first(col, pattern, "")


def prefix(col: Column, text: str) -> Column:
    return F.concat(F.lit(text), col)


def detect(col: Column, pattern: str) -> Column:
    return col.rlike(pattern)


def extract(col: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def pad_left(col: Column, width: int, fill: str = "0") -> Column:
    """Left pad that never cuts longer input."""
    return F.when(F.length(col) >= width, col).otherwise(F.lpad(col, width, fill))


def pad_single_digit(col: Column) -> Column:
    """``PC1`` becomes ``PC01``; ``PC10`` stays."""
    return F.regexp_replace(col, r"^([A-Za-z]{2})([0-9])$", "$10$2")


def title_case(col: Column) -> Column:
    return F.initcap(col)


def squeeze(col: Column) -> Column:
    """Collapse runs of blanks and drop leading ones."""
    return F.ltrim(F.regexp_replace(col, " +", " "))


def paste(*cols: Column, sep: str = " ") -> Column:
    """Join as text with a missing value written as ``NA``."""
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("NA")) for c in cols])


def strip_phrases(col: Column, phrases: list[str]) -> Column:
    """Remove each literal phrase wherever it occurs, then tidy the blanks."""
    if phrases:
        col = F.regexp_replace(col, "|".join(re.escape(p) for p in phrases), "")
    return squeeze(col)


def recode(df: DataFrame, col: str, mapping: dict[str, str]) -> DataFrame:
    """Exact dictionary recode by a map literal; values outside the dictionary stay as they are."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    lookup = F.create_map(*pairs)
    return df.withColumn(col, F.coalesce(F.try_element_at(lookup, F.col(col)), F.col(col)))


def canonical_label(col: Column, synonyms: dict[str, list[str]]) -> Column:
    """Map every listed synonym to its canonical label; unknown labels stay."""
    out = col
    for label, names in synonyms.items():
        out = F.when(col.isin(names), F.lit(label)).otherwise(out)
    return out
