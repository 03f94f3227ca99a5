"""Row numbers, fixed-size chunks and places within groups, over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_work_dir

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def numbered(df: DataFrame, order: str | Sequence[str], column: str = "row_no") -> DataFrame:
    """Number rows from 0 in the order of one or more columns, without sending them through one task.

    Rows are range-partitioned, sorted and numbered within their partition, and written to the work
    folder so that the numbers hold still. Adding the sizes of the partitions before it (one row per
    partition) makes a local number a global one.
    """
    columns = [order] if isinstance(order, str) else list(order)
    path = new_work_dir(df.sparkSession, "numbered")
    (
        df.repartitionByRange(*columns)
        .sortWithinPartitions(*columns)
        .withColumn("_slot", F.monotonically_increasing_id())
        .write.parquet(path)
    )
    rows = df.sparkSession.read.parquet(path).withColumn(
        "_part", F.shiftrightunsigned("_slot", _ROW_BITS)
    )
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    local = F.col("_slot") - F.shiftleft(F.col("_part"), _ROW_BITS)
    return rows.join(offsets, "_part").withColumn(column, F.col("_before") + local).drop(
        "_slot", "_part", "_before"
    )


def chunked(df: DataFrame, id_col: str, rows: int, column: str = "chunk_no") -> DataFrame:
    """Fixed-size chunks in id order, numbered from 0."""
    return (
        numbered(df, id_col, "_row_no")
        .withColumn(column, F.floor(F.col("_row_no") / F.lit(rows)).cast("long"))
        .drop("_row_no")
    )


def placed_in_group(df: DataFrame, group_col: str, order_col: str, column: str = "place") -> DataFrame:
    """Place of each row within its group, from 1. Groups are spread over tasks like all other rows."""
    rows = numbered(df, [group_col, order_col], "_row_no")
    starts = rows.groupBy(group_col).agg(F.min("_row_no").alias("_start"))
    return (
        rows.join(starts, group_col)
        .withColumn(column, F.col("_row_no") - F.col("_start") + 1)
        .drop("_row_no", "_start")
    )
