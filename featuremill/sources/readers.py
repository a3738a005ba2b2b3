"""File sources. Every reader takes an explicit schema; nothing is inferred."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_tsv(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = "\t", drop_blank: bool = True, check_header: bool = False) -> DataFrame:
    """Delimited text with a header row. Columns take the schema's names; all-blank rows are rejected.

    ``check_header`` fails on a header that does not name the columns in the schema's order. Cells that do not parse are missing;
    :func:`bad_cells` counts them. Compressed files (``.gz``, ``.bz2``, ``.zst``) are recognised by their suffix.
    """
    df = spark.read.schema(schema).option("sep", sep).option("header", True).option("enforceSchema", not check_header).csv(path)
    return df.na.drop("all") if drop_blank else df


def bad_cells(spark: SparkSession, path: str, schema: T.StructType, sep: str = "\t") -> DataFrame:
    """(column, bad): cells of each column that hold text which does not parse as the column's type."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.schema(text).option("sep", sep).option("header", True).csv(path)
    counts = [F.struct(F.lit(f.name).alias("column"), F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias("bad")) for f in schema]
    return raw.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def read_tsv_headerless(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = "\t") -> DataFrame:
    return spark.read.schema(schema).option("sep", sep).option("header", False).csv(path).na.drop("all")


def read_space_delimited(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return read_tsv(spark, path, schema, sep=" ")


#: The value of a folder named ``column=value``.
FOLDER_TAG = r"[^/=]+=([^/]*)/[^/]*$"


def read_sample_files(spark: SparkSession, pattern: str, schema: str | T.StructType, sample_regex: str) -> DataFrame:
    """One scan over all files of a pattern; the sample tag is taken from each row's file path, the mark of a missing one as null."""
    df = spark.read.schema(schema).option("sep", "\t").option("header", True).csv(pattern)
    tag = F.nullif(F.regexp_extract(F.col("_metadata.file_path"), sample_regex, 1), F.lit("__HIVE_DEFAULT_PARTITION__"))
    return df.select(tag.alias("sample"), *df.columns)


def header_rows(spark: SparkSession, path: str, rows: int, sep: str = "\t") -> list[list[str]]:
    """First lines of one file, split: only these few lines reach the driver."""
    lines = spark.read.text(path).filter(F.col("_metadata.file_block_start") == 0).select("value").take(rows)
    return [line["value"].split(sep) for line in lines]


def _without_header(head: list[str]):
    """Drop the first lines of each file: they come first in the block at offset 0, which one task reads in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            value, keep = batch.column("value"), []
            for i, (file, start) in enumerate(zip(batch.column("file").to_pylist(), batch.column("start").to_pylist())):
                at = seen.get(file, 0)
                if start == 0 and at < len(head):
                    if value[i].as_py() != head[at]:
                        raise ValueError(f"{file} has another header")
                    seen[file] = at + 1
                else:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([value.take(pa.array(keep, pa.int64()))], ["value"])

    return run


def read_multi_header(
    spark: SparkSession, path: str, rows: int, name_from: Iterable, types: dict[str, str] | None = None, sep: str = "\t"
) -> DataFrame:
    """Table under several header rows. ``name_from`` is a function of one column's header cells.

    The body is read as lines and split by executors. Every file starts with the same header lines, which are dropped by their
    place in the file; a file with another header fails the job.
    """
    head = header_rows(spark, path, rows, sep)
    width = max(len(r) for r in head)
    cells = [r + [""] * (width - len(r)) for r in head]
    names = [name_from(col) for col in zip(*cells, strict=True)]
    if len(set(names)) != len(names):
        raise ValueError("header rows give repeated column names")
    raw = [sep.join(r) for r in head]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    body = lines.mapInArrow(_without_header(raw), "value string").filter(F.regexp_replace("value", r"\s", "") != "")
    parts = F.split("value", sep, -1)
    types = types or {}
    cols = []
    for i, name in enumerate(names):
        cell = F.nullif(F.trim(F.try_element_at(parts, F.lit(i + 1))), F.lit(""))
        cols.append((cell.try_cast(types[name]) if name in types else cell).alias(name))
    return body.select(*cols)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Typed table kept as Parquet, in place of a spreadsheet or an annotation service."""
    return spark.read.parquet(path)


def read_bridge(spark: SparkSession, path: str, *attributes: str) -> DataFrame:
    """Distinct attribute rows of a bridge table; only the named columns are scanned."""
    return spark.read.parquet(path).select(*attributes).distinct()


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def literal_list(spark: SparkSession, values: list, name: str = "value") -> DataFrame:
    """One-column table that keeps the order of a list in ``rank``."""
    kind = "string" if all(isinstance(v, str) for v in values) else "double"
    return spark.createDataFrame([(v, i + 1) for i, v in enumerate(values)], f"{name} {kind}, rank int")
