"""Table scan with optional ids, filters and projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import OBJECT_ID_PATTERN
from ..functions import as_col

IN_LIST_ROWS = 1000  # longer id lists become a table and a semi join

_ACCEPTED = {
    T.StringType: (str,),
    T.BooleanType: (bool,),
    T.ByteType: (int,),
    T.ShortType: (int,),
    T.IntegerType: (int,),
    T.LongType: (int,),
    T.FloatType: (int, float),
    T.DoubleType: (int, float),
    T.ArrayType: (list, tuple),
    T.MapType: (dict,),
}


def filter_arguments(schema: T.StructType) -> dict[str, str]:
    """The filters a table accepts: every column by name, with its type."""
    return {field.name: field.dataType.simpleString() for field in schema.fields}


def check_filters(schema: T.StructType, filters: Mapping) -> None:
    """Reject unknown columns and values of the wrong kind, naming all of them at once."""
    errors = []
    for name, value in filters.items():
        if name not in schema.names:
            errors.append(f"unknown filter column: {name}")
            continue
        kinds = _ACCEPTED.get(type(schema[name].dataType))
        wrong_bool = isinstance(value, bool) and kinds is not None and bool not in kinds
        if value is not None and kinds is not None and (wrong_bool or not isinstance(value, kinds)):
            errors.append(f"filter {name} takes {schema[name].dataType.simpleString()}")
    if errors:
        raise ValueError("; ".join(errors))


def filter_condition(schema: T.StructType, filters: Mapping | None, any_of_list: bool = False) -> Column:
    """All filters joined by AND; a filter whose value is None does not count.

    A list for an array column means equality, or a shared element with ``any_of_list``.
    """
    filters = filters or {}
    check_filters(schema, filters)
    terms = []
    for name, value in filters.items():
        if value is None:
            continue
        kind = schema[name].dataType
        if isinstance(kind, T.ArrayType):
            wanted = F.array(*[F.lit(v) for v in value]).cast(kind)
            terms.append(F.arrays_overlap(F.col(name), wanted) if any_of_list else F.col(name) == wanted)
        elif isinstance(kind, T.MapType):
            terms.extend(F.col(name)[key] == F.lit(item) for key, item in value.items())
        else:
            terms.append(F.col(name) == F.lit(value))
    return reduce(and_, terms, F.lit(True))


def with_ids(df: DataFrame, ids: Sequence | DataFrame, id_col: str) -> DataFrame:
    """Rows whose id is listed. Short lists reach the file scan, longer ones are a semi join."""
    if isinstance(ids, DataFrame):
        wanted = ids.select(F.col(ids.columns[0]).alias(id_col))
        return df.join(wanted, id_col, "left_semi").select(*df.columns)
    # Both forms compare values of the column's type, cast from the texts of the ids.
    kind = df.schema[id_col].dataType
    texts = [str(i) for i in ids if i is not None]
    if len(texts) <= IN_LIST_ROWS:
        return df.where(F.col(id_col).isin([F.lit(i).try_cast(kind) for i in texts])) if texts else df.limit(0)
    listed = df.sparkSession.createDataFrame([(i,) for i in texts], "id string")
    wanted = listed.select(F.col("id").try_cast(kind).alias(id_col))
    return df.join(wanted, id_col, "left_semi").select(*df.columns)


def scan(
    df: DataFrame,
    ids: Sequence | DataFrame | None = None,
    filters: Mapping | None = None,
    columns: Sequence[str] | None = None,
    id_col: str = "id",
    any_of_list: bool = False,
) -> DataFrame:
    """The list query: optional id list (empty means all), equality filters, and projection."""
    rows = df.where(filter_condition(df.schema, filters, any_of_list)) if filters else df
    if ids is not None and (isinstance(ids, DataFrame) or len(ids) > 0):
        rows = with_ids(rows, ids, id_col)
    return rows.select(*columns) if columns else rows


def has_all_keys(mapping: Column | str, keys: Sequence[str]) -> Column:
    return reduce(and_, [F.map_contains_key(as_col(mapping), key) for key in keys], F.lit(True))


def has_any_value(mapping: Column | str, values: Sequence[str]) -> Column:
    return F.arrays_overlap(F.map_values(as_col(mapping)), F.array(*[F.lit(v) for v in values]))


def attribute_missing(column: Column | str, kind: T.DataType | None = None) -> Column:
    """Null or empty: what counts as a missing reference."""
    column = as_col(column)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return column.isNull() | (F.size(column) == 0)
    if isinstance(kind, T.StringType):
        return column.isNull() | (column == "")
    return column.isNull()


def valid_object_id(column: Column | str) -> Column:
    return as_col(column).rlike(OBJECT_ID_PATTERN)


def default_scope(df: DataFrame, ids: Sequence | DataFrame | None, id_col: str, default: Column) -> DataFrame:
    """The listed rows, or without a list the rows of the default predicate."""
    if ids is None or (not isinstance(ids, DataFrame) and len(ids) == 0):
        return df.where(default)
    return with_ids(df, ids, id_col)


def keyset_page(df: DataFrame, id_col: str, after, rows: int) -> DataFrame:
    """The next page after a cursor value, in id order."""
    page = df if after is None else df.where(F.col(id_col) > F.lit(after))
    return page.orderBy(id_col).limit(rows)


def first_row(df: DataFrame, id_col: str) -> DataFrame:
    return df.orderBy(id_col).limit(1)


def head_batch(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    return df.orderBy(id_col).limit(rows)


def distinct_on(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """First row per key in id order; rows without a key are dropped.

    The first pass aggregates two columns only, so a key with very many rows is combined before
    the shuffle; ids are unique, so the second pass picks whole rows by id.
    """
    firsts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_col).alias(id_col))
    return df.join(firsts.select(id_col), id_col, "left_semi").select(*df.columns)
