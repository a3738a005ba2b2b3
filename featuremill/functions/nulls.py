"""Missing-value rules: a missing value is a SQL NULL, and every rule below says what happens to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict(agg: Callable[[Column], Column], col: Column) -> Column:
    """Aggregate that is NULL as soon as one input is NULL (Spark aggregates skip NULLs)."""
    return F.when(F.count(col) == F.count(F.lit(1)), agg(col))


def ifelse(cond: Column, yes: Column, no: Column, missing: Column | None = None) -> Column:
    """Two-way choice where an unknown condition gives ``missing`` (NULL unless stated)."""
    if missing is None:
        return F.when(cond.isNull(), None).when(cond, yes).otherwise(no)
    return F.when(cond.isNull(), missing).when(cond, yes).otherwise(no)


def case_when(*branches: tuple[Column, Column], default: Column | None = None) -> Column:
    """First true branch wins; an unknown condition falls through."""
    first, *rest = branches
    out = F.when(*first)
    for cond, value in rest:
        out = out.when(cond, value)
    return out if default is None else out.otherwise(default)


def replace_null(col: Column, value) -> Column:
    return F.coalesce(col, F.lit(value))


def value_to_null(col: Column, value) -> Column:
    return F.nullif(col, F.lit(value))


def first_known(*cols: Column) -> Column:
    return F.coalesce(*cols)


def is_blank(col: Column) -> Column:
    """True for the empty string only; NULL is not blank."""
    return F.coalesce(col == "", F.lit(False))


def not_in_constants(col: Column, values: list) -> Column:
    """``NOT IN`` over constants that keeps rows with a missing value."""
    return F.coalesce(~col.isin(values), F.lit(True))
