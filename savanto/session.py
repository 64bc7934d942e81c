"""Session helpers: a local session for tests, and the shared folder for written tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators count on. Skewed joins are split at run time even when
# the split costs one more shuffle downstream.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

BUCKET_ROWS = 2_000_000

_made: dict[str, list[str]] = {}  # application: paths


def local_session(app: str = "savanto", cpus: int = 8, memory: str = "8g", folder: str | None = None) -> SparkSession:
    """A local session for tests and the benchmark; ``folder`` names the shared folder."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if folder:
        builder = builder.config("spark.checkpoint.dir", folder)
    spark = tune(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Switch the adaptive settings on; every one is a run-time SQL setting."""
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, named by ``spark.checkpoint.dir``.

    A session whose executors are threads of one process may run without the setting; it gets a folder of
    its own on that machine. On a cluster the setting is required.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and context.getCheckpointDir() is None and not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="savanto-"))
    return (folder or context.getCheckpointDir()).rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, on the list of :func:`discard`."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def discard(spark: SparkSession) -> int:
    """Remove everything this application stored by :func:`new_path` so far, and the tables over it.

    For the end of a job, when its result has been taken or written. Returns the number of paths.
    """
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        spark.sql(f"drop table if exists {_table_name(path)}")
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later steps restart from storage when executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table under the shared folder and read it back (columnar, prunable)."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _table_name(path: str) -> str:
    return "savanto_" + path.rsplit("/", 1)[-1].replace("-", "_")


def bucket_count(spark: SparkSession, rows: int) -> int:
    """Buckets of a table of about ``rows`` rows."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS))


def bucketed(df: DataFrame, keys: list[str], label: str, rows: int) -> DataFrame:
    """Write a table of about ``rows`` rows bucketed by ``keys``: joins on them move the other side only.

    The number of buckets follows the rows, so that a bucket stays what one task can hold.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    n = bucket_count(spark, rows)
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", path).saveAsTable(_table_name(path))
    return spark.table(_table_name(path))
