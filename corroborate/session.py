"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "corroborate", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench.

    On a cluster the session comes from spark-submit; nothing in the package
    depends on the values set here.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the cluster's, or a fresh local one in local mode.

    Outside local mode a missing setting is an error: executors could not read
    what the others wrote to their own disks.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="corroborate-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result once and read it back.

    For results that several later steps read and that are dear to recompute.
    The table lives in the shared checkpoint folder, so it outlives executors.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def fleeting_shuffles(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files of each query run inside as soon as it ends; else they stay until the driver's garbage is collected.

    For queries whose result is staged, so that none of their shuffles is read again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def light_batches(spark: SparkSession, size: int = 1 << 20) -> Iterator[None]:
    """Batches of at most ``size`` bytes, or one row, for the Python functions of what runs inside; a lower setting stays.

    Rows are counted to a batch, 10,000 by default, and whole documents or
    matrices would fill Spark's 64 MB. A task holds a batch several times: in the JVM
    on both sides of a worker, in the worker, and so for each function in a row.
    """
    before = spark.conf.get(ARROW_BYTES)
    limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    spark.conf.set(ARROW_BYTES, str(size if limit <= 0 else min(size, limit)))
    try:
        yield
    finally:
        spark.conf.set(ARROW_BYTES, before)


def spread(df: DataFrame) -> DataFrame:
    """Repartition for work that is heavy per row on few bytes.

    Adaptive execution sizes partitions by bytes and would leave such work to
    one task. Round robin, since a hash repartition on the keys of an earlier
    aggregation would be optimized away.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def small(df: DataFrame, rows: int = 50_000, size: int = 64 << 20) -> DataFrame:
    """Mark a staged table for broadcast, if it has at most ``rows`` rows and, written as JSON, ``size`` bytes.

    Looks at one row more than ``rows``, however long the table is.
    """
    head = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.length(F.to_json(F.struct(*df.columns)))), F.lit(0))).first()
    return F.broadcast(df) if head[0] <= rows and head[1] <= size else df


def spread_small(df: DataFrame) -> DataFrame:
    """:func:`spread` an input too small to fill the cluster with its own splits.

    Decided from the plan's size estimate, without a job. A large input keeps
    its splits and is not shuffled.
    """
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return spread(df) if size < split * spark.sparkContext.defaultParallelism else df
