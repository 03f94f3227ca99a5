"""Session settings and the shared work folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "corpuslens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; anything given in ``conf`` wins."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, where driver and
    executors are one machine, may fall back to a temporary folder.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="corpuslens-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def new_work_dir(spark: SparkSession, label: str) -> str:
    """A path below the work folder that no other run uses."""
    return f"{work_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Rows written to the work folder and read again: computed once, small on disk as columns, and of a size the planner knows."""
    path = new_work_dir(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    # With its schema, also a folder without rows can be read.
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_finished(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps that are done: Spark deletes them once the driver has
    collected the objects that stand for them, which it may not do by itself for a long time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _estimated_size(df: DataFrame) -> int:
    """The planner's estimate in bytes: nothing runs to learn it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def dealt(df: DataFrame, *keys: str, piece: int = 4 << 20) -> DataFrame:
    """Deal a table out by its keys, in pieces of one size: more of them the larger it is, one per core at least.

    For steps that hold what a task has read, such as aggregations of nearly as many groups as rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-_estimated_size(df) // piece)), *keys)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give costly per-row work one partition per core where a table is too small for that, such as one file.

    Meant for tables as they are read. Larger ones stay where they are, without a shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = _estimated_size(df)
    per_core = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")
    )
    return df.repartition(cores, *keys) if size < cores * per_core else df
