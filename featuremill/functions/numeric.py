"""Numeric helpers with the logarithm, division and rounding rules made explicit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEG_INF = float("-inf")


def log10_inf(col: Column) -> Column:
    """log10 with log10(0) = -inf, so that a mean over it stays -inf instead of skipping the row."""
    return F.when(col == 0, F.lit(NEG_INF)).otherwise(F.log10(col))


def log2_inf(col: Column) -> Column:
    return F.when(col == 0, F.lit(NEG_INF)).otherwise(F.log2(col))


def ratio(num: Column, den: Column) -> Column:
    """num / den; a zero denominator gives NULL."""
    return F.try_divide(num, den)


def percent(num: Column, den: Column) -> Column:
    return F.try_divide(num * 100.0, den)


def clamp(col: Column, low: float, high: float) -> Column:
    """Bound to [low, high]; NULL stays NULL (greatest/least alone would drop it)."""
    return F.when(col.isNotNull(), F.greatest(F.least(col, F.lit(high)), F.lit(low)))


def round_even(col: Column, digits: int = 0) -> Column:
    return F.bround(col, digits)


def equal_to_digits(a: Column, b: Column, digits: int) -> Column:
    return F.abs(a - b) < F.lit(0.5 * 10.0**-digits)


def to_double(col: Column) -> Column:
    """Text to number; text that is no number gives NULL."""
    return col.try_cast("double")


def days_between(end: Column, start: Column) -> Column:
    return F.datediff(end, start)


def to_day(col: Column) -> Column:
    return F.to_date(col, "yyyy-MM-dd")
