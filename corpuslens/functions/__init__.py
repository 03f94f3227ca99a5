"""Column functions. All of them are built from ``pyspark.sql.functions`` unless they say otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(value: Column | str) -> Column:
    """A column as it is, or a column name as a column."""
    return F.col(value) if isinstance(value, str) else value


def string_array(values) -> Column:
    """A literal array of strings, also when it is empty."""
    values = list(values)
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def any_match(value: Column, patterns) -> Column:
    """True where at least one of the regular expressions is found."""
    patterns = list(patterns)
    return value.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def unfold(df: DataFrame, keep, array: Column | str, name: str) -> DataFrame:
    """One row per array element, evaluating the array once.

    A plain explode makes the optimizer filter empty arrays first, which computes a costly array a
    second time; the outer form with a filter on the element does not.
    """
    return df.select(*keep, F.explode_outer(as_col(array)).alias(name)).where(F.col(name).isNotNull())


def any_contained(value: Column, markers) -> Column:
    """True where at least one of the texts is part of the value."""
    hit = F.lit(False)
    for marker in markers:
        hit = hit | value.contains(marker)
    return hit


def any_suffix(value: Column, suffixes) -> Column:
    """True where the value ends with at least one of the suffixes."""
    hit = F.lit(False)
    for suffix in suffixes:
        hit = hit | value.endswith(suffix)
    return hit
