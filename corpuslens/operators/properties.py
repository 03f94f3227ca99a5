"""Property tables and what they say about a firmware."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.properties import (
    PARSE_ERROR,
    UNKNOWN_VENDOR,
    is_property_line,
    property_key,
    property_value,
    vendor_of_file,
    version_of_file,
)


def property_rows(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Lines that hold a property, with its key and value."""
    return lines.where(is_property_line(line_col)).select(
        *[c for c in lines.columns if c != line_col],
        property_key(line_col).alias("key"),
        property_value(line_col).alias("value"),
    )


def last_value_per_key(rows: DataFrame, file_col: str, line_no: str) -> DataFrame:
    """One row per (file, key): the value of the last line."""
    return rows.groupBy(file_col, "key").agg(F.max_by("value", line_no).alias("value"))


def property_maps(
    rows: DataFrame, file_col: str, line_no: str, files: DataFrame | None = None
) -> DataFrame:
    """One map per property file; a file is bounded, so its keys fit one row.

    With the table of all property files, those without a property get the map that says so.
    """
    last = last_value_per_key(rows, file_col, line_no)
    maps = last.groupBy(file_col).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("properties")
    )
    if files is None:
        return maps
    failed = F.create_map(*[F.lit(v) for item in PARSE_ERROR.items() for v in item])
    return files.select(file_col).join(maps, file_col, "left").withColumn(
        "properties", F.coalesce("properties", failed)
    )


def first_file_wins(values: DataFrame, firmware_col: str, value_col: str, ordinal: str) -> DataFrame:
    return values.groupBy(firmware_col).agg(
        F.min_by(value_col, F.when(F.col(value_col).isNotNull(), F.col(ordinal))).alias(value_col)
    )


def last_file_wins(values: DataFrame, firmware_col: str, value_col: str, ordinal: str) -> DataFrame:
    return values.groupBy(firmware_col).agg(
        F.max_by(value_col, F.when(F.col(value_col).isNotNull(), F.col(ordinal))).alias(value_col)
    )


def detect_vendors(files: DataFrame, firmware_col: str, ordinal: str) -> DataFrame:
    """Vendor per firmware: the first property file that names one, else ``Unknown``."""
    named = files.select(firmware_col, ordinal, vendor_of_file("properties").alias("os_vendor"))
    found = first_file_wins(named, firmware_col, "os_vendor", ordinal)
    return found.withColumn("os_vendor", F.coalesce("os_vendor", F.lit(UNKNOWN_VENDOR)))


def detect_versions(files: DataFrame, firmware_col: str, ordinal: str) -> DataFrame:
    """Major version per firmware: the last property file that has one, else 0."""
    versions = files.select(firmware_col, ordinal, version_of_file("properties").alias("version_detected"))
    found = last_file_wins(versions, firmware_col, "version_detected", ordinal)
    return found.withColumn("version_detected", F.coalesce("version_detected", F.lit(0)))


def update_vendors(firmware: DataFrame, detected: DataFrame, firmware_col: str, scope: Column) -> DataFrame:
    """The firmware table with new vendors and an ``updated`` mark.

    A row changes if it is in scope and the detected vendor is known and differs.
    """
    new = F.col("_detected")
    changes = scope & new.isNotNull() & (new != UNKNOWN_VENDOR) & (new != F.col("os_vendor"))
    joined = firmware.join(detected.withColumnRenamed("os_vendor", "_detected"), firmware_col, "left")
    return (
        joined.withColumn("updated", F.coalesce(changes, F.lit(False)))
        .withColumn("os_vendor", F.when(F.col("updated"), new).otherwise(F.col("os_vendor")))
        .drop("_detected")
    )
