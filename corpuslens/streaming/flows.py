"""Streaming flows. Each takes a stream (or a folder) and gives a stream; ``run_once`` drives one to its end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import LOG_RETENTION_DAYS
from ..functions.paths import base_name
from ..session import new_work_dir
from ..sources import files

def watch_imports(spark: SparkSession, folder: str, glob: str | None, log: str) -> DataFrame:
    """New files of an import folder with their hashes (T01), however old their own times are.

    ``log`` names a folder that belongs to the stream like its checkpoint.
    """
    listed = files.watch_tree(spark, folder, log, glob=glob)
    return files.with_md5(listed, folder).select(base_name("path").alias("name"), "size", "md5", F.col("modified").alias("seen_at"))


def _started(stream: DataFrame, path: str) -> Callable:
    return lambda checkpoint: (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def import_new(arrivals: DataFrame, known: DataFrame, path: str) -> Callable:
    """Start: store each content once, leaving out what is known or came before.

    The hashes that came are the state of the stream, one per content: a batch costs what it brings, however much is
    stored. Keep the state in RocksDB where it outgrows the executors' memory.
    """
    return _started(arrivals.join(known.select("md5"), "md5", "left_anti").dropDuplicates(["md5"]).select(*arrivals.columns), path)


def log_windows(logs: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Records per tumbling window, level and tag (T03); a window is final once the watermark passes it.

    Times without a zone count as times of the session zone, because watermarks need a zone.
    """
    return (
        logs.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("window"), "level", "tag")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), "level", "tag", "n")
    )


def retained(logs: DataFrame, now, days: int = LOG_RETENTION_DAYS) -> DataFrame:
    """Records that are not older than the retention."""
    return logs.where(F.col("ts") >= now - F.expr(f"INTERVAL {days} DAYS"))


def scan_progress(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Latest status per app and scanner and how often it changed (T05). State is one row per app."""
    rows = events.withWatermark("ts", delay) if delay else events
    return rows.groupBy("app_id").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"),
        F.max("ts").alias("updated_at"),
        F.count("*").alias("changes"),
    )


def fan_out(arrivals: DataFrame, done: DataFrame, id_col: str, scanner: str, path: str) -> Callable:
    """Start: pending scan rows of new apps (T02), each app once however often it arrives.

    As with imports, the ids queued so far are the state of the stream.
    """
    from ..operators.scanners import pending_scans

    return _started(pending_scans(arrivals, done, id_col, scanner).dropDuplicates([id_col]), path)


def run_once(spark: SparkSession, stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process what is there, write it to the work folder, and read it back.

    Append mode uses the file sink. Update mode writes each batch to a folder of its own.
    """
    path = new_work_dir(spark, label)
    target, checkpoint = f"{path}/table", f"{path}/checkpoint"
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", target).outputMode("append").start()
    else:

        def write_batch(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

        query = writer.foreachBatch(write_batch).outputMode(mode).start()
    query.awaitTermination()
    return spark.read.schema(_with_batch(stream.schema, mode)).parquet(target)


def _with_batch(schema, mode):
    from pyspark.sql import types as T

    return schema if mode == "append" else T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])


def latest_per_key(updates: DataFrame, key: str) -> DataFrame:
    """The newest update per key of an update-mode result."""
    columns = [c for c in updates.columns if c not in (key, "batch")]
    newest = updates.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("_row"))
    return newest.select(key, "_row.*")
