"""Sinks (S09-S13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import LOG_LEVELS
from ..functions.build import meta_group
from ..functions.paths import drop_marked_segments


def write_references(rows: DataFrame, path: str, key_col: str | None = None) -> None:
    """Id lists as JSON lines; with a key, one folder per key."""
    writer = rows.write
    (writer.partitionBy(key_col) if key_col else writer).json(path)


def export_folder(firmware_id: Column, partition: Column, relative_path: Column, name: Column) -> Column:
    """Folder an exported file goes to: firmware, partition, and its path without unpacking folders."""
    part = F.when(partition == "/", F.lit("root")).otherwise(partition)
    folders = drop_marked_segments(F.replace(relative_path, name, F.lit("")))
    return F.regexp_replace(F.concat_ws("/", firmware_id, part, folders), "/+", "/")


def export_files(files: DataFrame, path: str) -> None:
    """Exported file rows laid out as firmware and partition folders."""
    files.write.partitionBy("firmware_id", "partition_name").parquet(path)


def append_log(records: DataFrame, path: str, tags: list[str]) -> None:
    """Append log records with their tags, one folder per day; unknown levels become INFO."""
    level = F.when(F.col("level").isin(LOG_LEVELS), F.col("level")).otherwise(F.lit("INFO"))
    tagged = records.withColumn("level", level)
    if "tags" not in records.columns:
        tagged = tagged.withColumn("tags", F.array(*[F.lit(t) for t in tags]))
    tagged.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def write_module_lists(modules: DataFrame, path: str, module_col: str, partition_col: str) -> None:
    """Module names as build-meta lines, one folder per meta group."""
    line = F.concat(F.lit("    "), F.col(module_col), F.lit(" \\"))
    modules.select(line.alias("value"), meta_group(partition_col).alias("meta_group")).write.partitionBy(
        "meta_group"
    ).text(path)


def write_graph(nodes: DataFrame, edges: DataFrame, membership: DataFrame, path: str) -> None:
    """A similarity result as three tables. Their size needs no limit."""
    nodes.write.parquet(f"{path}/nodes")
    edges.write.parquet(f"{path}/edges")
    membership.write.parquet(f"{path}/membership")
