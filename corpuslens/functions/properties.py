"""Property parsing and lookup."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import RAW_VENDOR_KEYS, VENDOR_KEYS, VENDOR_NAMES, VERSION_KEYS
from . import as_col

PARSE_ERROR = {"error": "could not parse build.prop properties"}
UNKNOWN_VENDOR = "Unknown"


def stripped_line(line: Column | str) -> Column:
    """A line without the white space at its end, a carriage return or tab included."""
    return F.regexp_replace(as_col(line), r"[\s\x{1C}-\x{1F}\x{85}\p{Z}]+$", "")


def is_property_line(line: Column | str) -> Column:
    """A line counts if it holds exactly one equals sign; comment lines are not special."""
    return F.size(F.split(stripped_line(line), "=")) == 2


def property_key(line: Column | str) -> Column:
    return F.replace(F.split(stripped_line(line), "=")[0], F.lit("."), F.lit("_"))


def property_value(line: Column | str) -> Column:
    return F.split(stripped_line(line), "=")[1]


def parse_properties(lines: Column | str) -> Column:
    """An ordered array of lines as a map. A key that occurs again takes its last value."""
    split = F.transform(as_col(lines), lambda line: F.split(stripped_line(line), "="))
    kept = F.filter(split, lambda parts: F.size(parts) == 2)
    pairs = F.array_sort(
        F.transform(
            kept,
            lambda parts, i: F.struct(
                F.replace(parts[0], F.lit("."), F.lit("_")).alias("key"), i.alias("at"), parts[1].alias("value")
            ),
        )
    )
    # Sorted by key and place, the last of a key is the one whose successor has another key.
    follows = F.concat(F.slice(pairs, 2, F.greatest(F.size(pairs), F.lit(1))), F.slice(pairs, -1, 1))
    newest = F.filter(
        F.zip_with(pairs, follows, lambda p, q: F.struct(p.alias("own"), ((p["key"] != q["key"]) | (p["at"] == q["at"])).alias("last"))),
        lambda z: z["last"],
    )
    parsed = F.map_from_entries(F.transform(newest, lambda z: F.struct(z["own"]["key"], z["own"]["value"])))
    failed = F.create_map(*[F.lit(v) for item in PARSE_ERROR.items() for v in item])
    return F.when(F.size(kept) > 0, parsed).otherwise(failed)


def first_of_keys(properties: Column | str, keys: Sequence[str]) -> Column:
    """Value of the first listed key that is present and not empty."""
    properties = as_col(properties)
    return F.coalesce(*[F.nullif(properties[key], F.lit("")) for key in keys])


def major_version(value: Column | str) -> Column:
    """The number before the first dot; null where that is no number."""
    return F.split(as_col(value), "\\.")[0].try_cast("int")


def version_of_file(properties: Column | str, keys: Sequence[str] = VERSION_KEYS) -> Column:
    """Major version a property file contributes: null without a version, 0 if it is no number."""
    release = first_of_keys(properties, keys)
    return F.when(release.isNotNull(), F.coalesce(major_version(release), F.lit(0)))


def _vendor_lookup(names: Mapping[str, str]) -> tuple[Column, Column]:
    """The catalogue as a map, and its keys in matching order."""
    keys = F.array(*[F.lit(k) for k in names])
    return F.map_from_arrays(keys, F.array(*[F.lit(v) for v in names.values()])), keys


def _vendor(value: Column, keep_raw: Column, lookup: Column, keys: Column) -> Column:
    trimmed = F.trim(value)
    lowered = F.lower(trimmed)
    partial = F.get(F.filter(keys, lambda key: F.contains(lowered, key)), F.lit(0))
    raw = F.when(keep_raw & (trimmed != "") & (lowered != "unknown"), trimmed)
    return F.when(value != "", F.coalesce(lookup[lowered], lookup[partial], raw))


def vendor_of_value(
    value: Column | str, keep_raw: bool, names: Mapping[str, str] = VENDOR_NAMES
) -> Column:
    """Vendor of a text: exact match, else the first catalogue key it contains, else (where allowed) itself."""
    lookup, keys = _vendor_lookup(names)
    return _vendor(as_col(value), F.lit(keep_raw), lookup, keys)


def vendor_of_file(
    properties: Column | str,
    keys: Sequence[str] = VENDOR_KEYS,
    raw_keys: Sequence[str] = RAW_VENDOR_KEYS,
    names: Mapping[str, str] = VENDOR_NAMES,
) -> Column:
    """Vendor a property file names; null where it names none.

    The candidate values form one array, so the catalogue stands in the plan once and not per key.
    """
    properties = as_col(properties)
    lookup, ordered = _vendor_lookup(names)
    values = F.array(
        *[F.struct(properties[k].alias("value"), F.lit(k in raw_keys).alias("raw")) for k in keys]
    )
    vendors = F.transform(
        F.filter(values, lambda v: v["value"].isNotNull()),
        lambda v: _vendor(v["value"], v["raw"], lookup, ordered),
    )
    return F.get(F.filter(vendors, lambda v: v.isNotNull()), F.lit(0))
