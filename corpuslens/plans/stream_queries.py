"""Streams. Each is driven to the end of its input and compared with its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_work_dir
from ..streaming import flows as fl
from ..streaming import progress as pg
from .registry import Tables, query


def stream(t: Tables, name: str) -> DataFrame:
    """One of the given tables as a file stream, whether it is one file or a folder of files."""
    schema = t.spark.read.parquet(t.path(name)).schema
    # A stream takes a folder or a pattern; this pattern fits the table's own path only.
    return t.spark.readStream.schema(schema).parquet(f"{t.folder}/{name}.parque[t]")


LEVEL_SQL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END"
WINDOW_SQL = f"SELECT date_trunc('day', ts) AS window_start, {LEVEL_SQL} AS level, event_type AS tag, count(*) AS n FROM events GROUP BY 1, 2, 3"


def as_logs(events: DataFrame) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARNING").otherwise("INFO")
    return events.select("event_id", "ts", level.alias("level"), F.col("event_type").alias("tag"))


def zoneless(windows: DataFrame) -> DataFrame:
    return windows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("log_window_counts", WINDOW_SQL)
def log_window_counts(t: Tables) -> DataFrame:
    return zoneless(fl.log_windows(as_logs(t.events)))


@query(
    "log_window_stream",
    f"SELECT * FROM ({WINDOW_SQL}) w WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)",
)
def log_window_stream(t: Tables) -> DataFrame:
    """The windows a stream has closed: those that end before the watermark."""
    return zoneless(fl.run_once(t.spark, fl.log_windows(as_logs(stream(t, "events"))), "log-windows"))


@query(
    "log_retention",
    "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY",
)
def log_retention(t: Tables) -> DataFrame:
    newest = t.events.agg(F.max("ts")).scalar()
    return fl.retained(t.events, newest).select("event_id")


PROGRESS_SQL = """
    SELECT user_id AS app_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS updated_at, count(*) AS changes FROM events GROUP BY 1
"""


def as_progress(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("app_id"), "ts", "event_id", F.col("event_type").alias("status"))


@query("scan_progress", PROGRESS_SQL)
def scan_progress(t: Tables) -> DataFrame:
    updates = fl.run_once(t.spark, fl.scan_progress(as_progress(stream(t, "events"))), "progress", "update")
    return fl.latest_per_key(updates, "app_id")


@query("scan_progress_batch", PROGRESS_SQL)
def scan_progress_batch(t: Tables) -> DataFrame:
    return fl.scan_progress(as_progress(t.events))


@query("scan_progress_bounded", PROGRESS_SQL)
def scan_progress_bounded(t: Tables) -> DataFrame:
    """The same statuses from a stream whose state has timers; a status counts as an end here if it is an error."""
    events = as_progress(stream(t, "events"))
    with pg.timers(t.spark):
        updates = fl.run_once(t.spark, pg.bounded_progress(events, idle="400 days", keep="400 days", terminal=("error",)), "bounded", "update")
    newest = fl.latest_per_key(updates, "app_id")
    return newest.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


BLOCK_ROWS = 2000  # documents per file at most, so that no task writes a whole firmware


@query(
    "stream_import",
    f"""
    WITH f AS (SELECT source, string_agg(text || chr(10), '' ORDER BY doc_id) AS content FROM documents
               GROUP BY source, lang, doc_id // {BLOCK_ROWS})
    SELECT sum(strlen(content))::BIGINT AS bytes FROM
      (SELECT DISTINCT content FROM f WHERE content NOT IN (SELECT content FROM f WHERE source = 'src0')) n
    """,
)
def stream_import(t: Tables) -> DataFrame:
    """Watch a folder that holds every file twice and some files that are stored already."""
    root = new_work_dir(t.spark, "watched")
    texts = t.documents.select(
        "doc_id", F.col("source").alias("firmware"), F.col("lang").alias("part"),
        F.floor(F.col("doc_id") / BLOCK_ROWS).alias("block"), F.col("text").alias("value"),
    )
    # Files are written in a fixed order, so that both copies are equal.
    keys = ["firmware", "part", "block"]
    spread_out = texts.repartition(*keys).sortWithinPartitions(*keys, "doc_id").drop("doc_id")
    for copy in ("a", "b"):
        spread_out.write.partitionBy(*keys).text(f"{root}/in/{copy}")
    known = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(
        f"{root}/in/a/firmware=src0"
    ).select(F.md5("content").alias("md5"))
    known.write.parquet(f"{root}/known")
    arrivals = fl.watch_imports(t.spark, f"{root}/in", "*.txt", f"{root}/log")
    start = fl.import_new(arrivals, t.spark.read.parquet(f"{root}/known"), f"{root}/table")
    start(f"{root}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{root}/table").agg(F.sum("size").alias("bytes"))


@query(
    "scan_fanout",
    "SELECT doc_id, 'TEXT' AS scanner_name, 'queued' AS status FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def scan_fanout(t: Tables) -> DataFrame:
    path = new_work_dir(t.spark, "fanout")
    arrivals = stream(t, "documents").select("doc_id")
    start = fl.fan_out(arrivals, t.labels, "doc_id", "TEXT", f"{path}/table")
    start(f"{path}/checkpoint").awaitTermination()
    schema = arrivals.schema.add("scanner_name", "string").add("status", "string")
    # With its schema, so that a run in which nothing is queued can be read.
    return t.spark.read.schema(schema).parquet(f"{path}/table").select("doc_id", "scanner_name", "status")
