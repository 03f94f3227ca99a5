"""Corpus statistics, one function per shape (A03-A23). Results are long tables.

Counting functions unfold a row into (attribute, value) entries and count them in one aggregation;
Spark combines the entries per task before the shuffle, so a value that fills most rows costs one
entry per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import unfold


def _atomic_entries(attributes: Mapping[str, Column] | Sequence[str]) -> Column:
    columns = attributes if isinstance(attributes, Mapping) else {name: F.col(name) for name in attributes}
    return F.array(
        *[
            F.struct(F.lit(name).alias("attribute"), column.cast("string").alias("value"))
            for name, column in columns.items()
        ]
    )


def _list_entries(attributes: Mapping[str, Column] | Sequence[str]) -> Column:
    columns = attributes if isinstance(attributes, Mapping) else {name: F.col(name) for name in attributes}

    def entries(name: str, column: Column) -> Column:
        elements = F.coalesce(column.cast("array<string>"), F.array().cast("array<string>"))
        return F.transform(elements, lambda v: F.struct(F.lit(name).alias("attribute"), v.alias("value")))

    return F.concat(*[entries(name, column) for name, column in columns.items()])


def _unfold(df: DataFrame, entries: Column, *keep: str) -> DataFrame:
    return unfold(df, keep, entries, "_e").select(
        *keep, F.col("_e.attribute").alias("attribute"), F.col("_e.value").alias("value")
    )


def _count(entries: DataFrame) -> DataFrame:
    return (
        entries.where(F.col("value").isNotNull())
        .groupBy("attribute", "value")
        .agg(F.count("*").alias("n"))
    )


def atomic_counts(df: DataFrame, attributes: Mapping[str, Column] | Sequence[str]) -> DataFrame:
    """Rows per value of each attribute."""
    return _count(_unfold(df, _atomic_entries(attributes)))


def list_counts(df: DataFrame, attributes: Mapping[str, Column] | Sequence[str]) -> DataFrame:
    """Occurrences per element of each array attribute."""
    return _count(_unfold(df, _list_entries(attributes)))


def atomic_references(df: DataFrame, attributes: Mapping[str, Column] | Sequence[str], id_col: str) -> DataFrame:
    """Which rows hold a value, as (attribute, value, id): a list per value has no size limit this way."""
    return _unfold(df, _atomic_entries(attributes), id_col).where(F.col("value").isNotNull())


def list_references(df: DataFrame, attributes: Mapping[str, Column] | Sequence[str], id_col: str) -> DataFrame:
    """Which rows hold an element, each row once per element."""
    columns = attributes if isinstance(attributes, Mapping) else {name: F.col(name) for name in attributes}
    once = {name: F.array_distinct(column) for name, column in columns.items()}
    return _unfold(df, _list_entries(once), id_col).where(F.col("value").isNotNull())


def presence_counts(df: DataFrame, attributes: Mapping[str, Column] | Sequence[str]) -> DataFrame:
    """Rows with and without elements in each array attribute."""
    columns = attributes if isinstance(attributes, Mapping) else {name: F.col(name) for name in attributes}
    return atomic_counts(
        df, {name: F.coalesce(F.size(column) > 0, F.lit(False)) for name, column in columns.items()}
    )


def cardinality(df: DataFrame, owner_col: str, element_col: str) -> DataFrame:
    """Distinct elements per owner."""
    return df.groupBy(owner_col).agg(F.countDistinct(element_col).alias("elements"))


def cardinality_series(per_owner: DataFrame) -> DataFrame:
    """How many owners have how many elements."""
    return per_owner.groupBy("elements").agg(F.count("*").alias("owners"))


def two_level_counts(df: DataFrame, owner_col: str, level_col: str) -> DataFrame:
    """Entries per level and owners with that level; the row without a level is the total."""
    per_owner = df.groupBy(owner_col, level_col).agg(F.count("*").alias("entries"))
    return per_owner.rollup(level_col).agg(
        F.sum("entries").alias("entries"), F.count("*").alias("owner_levels")
    )


def averages(df: DataFrame, attributes: Mapping[str, Column]) -> DataFrame:
    return df.agg(*[F.avg(column).alias(name) for name, column in attributes.items()])


def histograms(df: DataFrame, widths: Mapping[str, tuple[Column, float]]) -> DataFrame:
    """Fixed-width buckets of several numeric attributes, counted in one pass."""
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("attribute"),
                F.floor(column / F.lit(float(width))).cast("long").alias("bucket"),
            )
            for name, (column, width) in widths.items()
        ]
    )
    return (
        df.select(F.explode(entries).alias("_e"))
        .groupBy(F.col("_e.attribute").alias("attribute"), F.col("_e.bucket").alias("bucket"))
        .agg(F.count("*").alias("n"))
        .where(F.col("bucket").isNotNull())
    )


def totals(df: DataFrame, size: Column, unique: Mapping[str, Column]) -> DataFrame:
    """Row count, byte total and distinct counts of a table."""
    return df.agg(
        F.count("*").alias("row_count"),
        F.sum(size).alias("byte_total"),
        *[F.countDistinct(column).alias(f"unique_{name}") for name, column in unique.items()],
    )


def top_values(counts: DataFrame, attributes: Sequence[str], rows: int) -> DataFrame:
    """The most frequent values of each attribute, from one pass over the counted values.

    The rank limit reaches below the shuffle: a task passes on no more than ``rows`` rows per attribute.
    """
    rank = F.row_number().over(Window.partitionBy("attribute").orderBy(F.desc("n"), "value"))
    wanted = counts.where(F.col("attribute").isin(list(attributes)))
    return wanted.withColumn("_rank", rank).where(F.col("_rank") <= rows).drop("_rank")


def attributes_within(counts: DataFrame, limit: int) -> DataFrame:
    """Every attribute with its number of distinct values, and whether that is over the limit of a consumer."""
    sizes = counts.groupBy("attribute").agg(F.count("*").alias("values"))
    return sizes.withColumn("over_limit", F.col("values") > limit)
