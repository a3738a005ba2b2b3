"""Wide/long reshaping, splitting and uniting of columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def starts_with(df: DataFrame, *prefixes: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes)]


def by_position(df: DataFrame, first: int, last: int) -> list[str]:
    """Column names from position ``first`` to ``last``, both counted from 1 and included."""
    return df.columns[first - 1 : last]


def relocate(df: DataFrame, *front: str) -> DataFrame:
    return df.select(*front, *[c for c in df.columns if c not in front])


def rename_all(df: DataFrame, f: Callable[[str], str]) -> DataFrame:
    return df.toDF(*[f(c) for c in df.columns])


def across(df: DataFrame, f: Callable[[Column], Column], cols: list[str] | None = None) -> DataFrame:
    chosen = set(cols or df.columns)
    return df.select(*[f(F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns])


def to_long(df: DataFrame, ids: list[str], values: list[str], name_to: str, value_to: str) -> DataFrame:
    return df.unpivot(ids, values, name_to, value_to)


def to_wide(df: DataFrame, keys: list[str], names: str, value: str, levels: list, fill=None, name=str) -> DataFrame:
    """Long to wide with stated columns, in one aggregate. A repeated cell and a level that is not stated fail the job."""
    stray = F.max(F.when(~F.coalesce(F.col(names).isin(*levels), F.lit(False)), F.coalesce(F.col(names).cast("string"), F.lit("a missing level"))))
    checked = F.when(stray.isNotNull(), F.raise_error(F.concat(F.lit("not among the levels: "), stray)))
    def cell(level):
        here = F.col(names) == F.lit(level)
        many = F.count_if(here) > 1
        v = F.max(F.when(here, F.col(value)))
        if fill is not None:
            v = F.coalesce(v, F.lit(fill))
        return F.when(many, F.raise_error(F.lit(f"several values for {level}"))).when(checked.isNull(), v).alias(name(level))

    return df.groupBy(*keys).agg(*[cell(v) for v in levels])


def transpose(df: DataFrame, row_key: str, columns: list[str], levels: list, new_key: str = "column") -> DataFrame:
    """Rows become columns; ``levels`` are the row keys that turn into column names."""
    return to_wide(to_long(df, [row_key], columns, new_key, "__v"), [new_key], row_key, "__v", levels)


def split_column(df: DataFrame, col: str, sep: str, into: list[str]) -> DataFrame:
    """Split on a literal separator into named columns; a row with another number of parts fails."""
    import re

    parts = F.split(F.col(col), re.escape(sep))
    right = F.size(parts) == len(into)
    checked = F.when(right | F.col(col).isNull(), parts).otherwise(F.raise_error(F.lit(f"wrong number of parts in {col}")))
    out = df.withColumn("__parts", checked)
    return out.withColumns({n: F.col("__parts")[i] for i, n in enumerate(into)}).drop("__parts", col)


def unite(df: DataFrame, out: str, cols: list[str], sep: str = "_", remove: bool = True) -> DataFrame:
    """Join columns as text, a missing value written as ``NA``."""
    united = F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in cols])
    df = df.withColumn(out, united)
    return df.drop(*[c for c in cols if c != out]) if remove else df
