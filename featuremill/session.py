"""Session construction, and the one place that stores intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folder: tempfile.TemporaryDirectory | None = None
_swept: set[str] = set()


def local_session(cores: int | str = "*", app: str = "featuremill", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks; on a cluster the job brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def stage_folder(spark: SparkSession) -> str:
    """Folder for stored intermediates: below the shared folder named in ``spark.checkpoint.dir``.

    The application's part of it is removed when the driver ends. Only a local session without that setting gets a temporary folder, removed when Python exits.
    """
    global _local_folder
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        folder = f"{shared.rstrip('/')}/featuremill-{spark.sparkContext.applicationId}"
        if folder not in _swept and hasattr(spark, "_jvm"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            files = path.getFileSystem(spark._jsc.hadoopConfiguration())
            files.mkdirs(path)
            files.deleteOnExit(path)
            _swept.add(folder)
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_folder is None:
        _local_folder = tempfile.TemporaryDirectory(prefix="featuremill-", ignore_cleanup_errors=True)
    return _local_folder.name


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store the rows as a table in the shared folder and read them back.

    A written table survives the loss of executors, is evaluated exactly once, tells the planner its
    size (so that small sides are broadcast and large ones are not), and drops the grown plan with
    its inferred constraints, which a long loop would otherwise drag along.
    """
    path = f"{stage_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "lz4").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def release(stored: DataFrame) -> None:
    """Remove a table that :func:`cut_lineage` wrote, once nothing reads it any more. Loops keep two rounds on disk at most.

    Does nothing for other tables, and where the session has no access to its file systems; the table then stays until the driver ends.
    """
    path, spark = getattr(stored, "_stored_at", None), stored.sparkSession
    if path and hasattr(spark, "_jvm"):
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
