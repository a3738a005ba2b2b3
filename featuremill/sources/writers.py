"""File sinks. All writes are one file per task; nothing is gathered first."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, sep: str = "\t", mode: str = "errorifexists", header: bool = True, compression: str = "none") -> None:
    df.write.mode(mode).option("sep", sep).option("header", header).option("compression", compression).csv(path)


def write_sample_files(df: DataFrame, path: str, sample: str, sep: str = "\t", mode: str = "errorifexists") -> None:
    """A folder ``sample=value`` of delimited files for each value of the column, all in one job; a missing value has a folder too."""
    df.write.mode(mode).partitionBy(sample).option("sep", sep).option("header", True).csv(path)


def write_multi_header(df: DataFrame, path: str, head: list[list[str]], sep: str = "\t", mode: str = "errorifexists") -> None:
    """Delimited text under several header rows. Each task writes a file of its own, which starts with all of them."""
    first = [sep.join(row) for row in head]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.string())], ["value"])
        for batch in batches:  # under the same schema, whose column may be null
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])

    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    df.select(F.concat_ws(sep, *cells).alias("value")).mapInArrow(run, "value string").write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_tsv(df, path, sep=",", mode=mode)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Result table as Parquet, in place of a spreadsheet."""
    df.write.mode(mode).parquet(path)


def finished(spark, path: str) -> bool:
    """Whether a write to the folder has come to its end."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def reuse_or_build(df_builder, spark, path: str) -> DataFrame:
    """Read a stored intermediate result, or build, store and read it back. A half-written folder is built anew."""
    if not finished(spark, path):
        write_table(df_builder(), path, mode="overwrite")
    return spark.read.parquet(path)
