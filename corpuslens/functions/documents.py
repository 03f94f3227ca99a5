"""Map and JSON functions for stored documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import KEY_REPLACEMENT
from . import as_col


def storable_key(key: Column | str) -> Column:
    """Leading dollar signs and every dot become the replacement text."""
    started = F.regexp_replace(as_col(key), "^[$]+", KEY_REPLACEMENT)
    return F.replace(started, F.lit("."), F.lit(KEY_REPLACEMENT))


def storable_map(mapping: Column | str, depth: int = 1) -> Column:
    """Sanitise the keys of a map, and of the maps nested in it down to ``depth`` levels."""
    mapping = as_col(mapping)
    if depth > 1:
        mapping = F.transform_values(mapping, lambda _, value: storable_map(value, depth - 1))
    return F.transform_keys(mapping, lambda key, _: storable_key(key))


def list_of_scalar_or_list(value: Column | str) -> Column:
    """A JSON text that holds a number or a list of numbers, as a list."""
    value = F.trim(as_col(value))
    many = F.from_json(value, "array<int>")
    return F.when(value.startswith("["), many).otherwise(F.array(value.try_cast("int")))


def encode_json(*fields: Column) -> Column:
    """A row as JSON text; sets are passed as sorted arrays, ids and references as strings."""
    return F.to_json(F.struct(*fields))
