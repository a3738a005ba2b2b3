"""Small helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose column holds about ``limit`` bytes; a longer value comes alone."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    yield batch.slice(start)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(text, F.lit("")), upper, upper.lower())


def without(rows: DataFrame, made: list[str], needed: list[str]) -> DataFrame:
    """Rows without the columns that an operator is about to make; fails when it needs to read one of them."""
    if clash := set(made) & set(needed):
        raise ValueError(f"columns {sorted(clash)} are read and cannot be made too")
    return rows.drop(*made)


def hash_fraction(*cols: Column | str) -> Column:
    """A stable number in [0, 1) from a row's values, for bounded samples."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def bounded_sample(rows: DataFrame, bound: int, *keys: str) -> DataFrame:
    """At most ``bound`` rows, chosen by the hash of ``keys``; all rows when there are no more.

    The rows are counted first, so only a few more than ``bound`` reach the final top-k.
    """
    n = rows.count()
    if n <= bound:
        return rows
    share = hash_fraction(F.lit("sample"), *keys)
    return rows.filter(share < 1.3 * bound / n + 1e-9).orderBy(share, *keys).limit(bound)
