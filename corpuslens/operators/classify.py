"""File-name classification and lookups by name."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import (
    DEFAULT_APPS,
    EXPORT_MARKERS_SKIPPED,
    IMAGE_NAME_MARKERS_SKIPPED,
    IMAGE_NAME_PREFIX_SKIPPED,
    IMAGE_PATTERNS,
    OVERRIDE_NAME_SKIPPED,
    PROPERTY_FILE_PATTERNS,
    SINGLETON_APPS,
    SYSTEM_NAME_MARKERS_SKIPPED,
)
from ..functions import any_contained, any_match, as_col
from .patterns import matches


def image_labels(
    name: Column | str, is_directory: Column, patterns: Mapping[str, Sequence[str]] = IMAGE_PATTERNS
) -> Column:
    """Partition labels whose image patterns a file name matches.

    The catalogue is fixed and small, so it is part of the expression: one pass over the files.
    """
    lowered = F.lower(as_col(name))
    eligible = ~is_directory & ~lowered.startswith(IMAGE_NAME_PREFIX_SKIPPED)
    eligible = eligible & ~any_contained(lowered, IMAGE_NAME_MARKERS_SKIPPED)
    labels = []
    for label, label_patterns in patterns.items():
        hit = eligible & any_match(lowered, label_patterns)
        if label == "system":
            hit = hit & ~any_contained(lowered, SYSTEM_NAME_MARKERS_SKIPPED)
        labels.append(F.when(hit, F.lit(label)))
    return F.array_compact(F.array(*labels))


def image_pattern_table(spark: SparkSession, patterns: Mapping[str, Sequence[str]] = IMAGE_PATTERNS) -> DataFrame:
    """The catalogue as a table ``(label, pattern)``."""
    rows = [(label, pattern) for label, label_patterns in patterns.items() for pattern in label_patterns]
    return spark.createDataFrame(rows, "label string, pattern string")


def labelled_images(files: DataFrame, id_col: str, name_col: str, is_directory: Column, patterns: DataFrame) -> DataFrame:
    """``(id, name, label)`` of the files whose names match a pattern of a table ``(label, pattern)``, which may be of any size."""
    lowered = F.lower(name_col)
    eligible = ~is_directory & ~lowered.startswith(IMAGE_NAME_PREFIX_SKIPPED) & ~any_contained(lowered, IMAGE_NAME_MARKERS_SKIPPED)
    names = files.where(eligible).select(id_col, name_col, lowered.alias("_lowered"))
    found = matches(names, "_lowered", patterns.select("label", "pattern"), "pattern")
    other = (F.col("label") == "system") & any_contained(F.col("_lowered"), SYSTEM_NAME_MARKERS_SKIPPED)
    return found.where(~other).select(id_col, name_col, "label").distinct()


def first_pattern(name: Column | str, patterns: Sequence[str]) -> Column:
    """Position (from 1) of the first pattern the name matches; null if none does."""
    name = as_col(name)
    return F.coalesce(*[F.when(name.rlike(p), F.lit(i)) for i, p in enumerate(patterns, 1)])


def best_match_per_owner(
    files: DataFrame, owner_col: str, name_col: str, id_col: str, patterns: Sequence[str]
) -> DataFrame:
    """Per owner the file of the most specific pattern, the lowest id if several match it."""
    ranked = files.withColumn("_ord", first_pattern(name_col, patterns)).where(F.col("_ord").isNotNull())
    best = ranked.groupBy(owner_col).agg(F.min(F.struct("_ord", id_col)).alias("_best"))
    return best.select(
        owner_col, F.col("_best._ord").alias("pattern_no"), F.col(f"_best.{id_col}").alias(id_col)
    )


def exportable(name: Column | str, is_directory: Column, pattern: str) -> Column:
    """Files an export by name pattern takes (case-insensitive, without unpacking leftovers)."""
    name = as_col(name)
    return ~is_directory & name.rlike(f"(?i){pattern}") & ~any_contained(name, EXPORT_MARKERS_SKIPPED)


def matches_at_start(name: Column | str, patterns: Iterable[str]) -> Column:
    return any_match(as_col(name), [f"^(?:{p})" for p in patterns])


def is_property_file(name: Column | str) -> Column:
    return any_match(F.lower(as_col(name)), PROPERTY_FILE_PATTERNS)


def is_app_file(name: Column | str) -> Column:
    return F.lower(as_col(name)).endswith(".apk")


def app_override(
    directory: Column | str,
    singletons: Sequence[str] = SINGLETON_APPS,
    defaults: Sequence[str] = DEFAULT_APPS,
) -> Column:
    """The built-in module an app replaces: a singleton it contains, else a default it names as a word."""
    directory = as_col(directory)
    singleton_names = F.array(*[F.lit(s) for s in singletons])
    default_names = F.array(*[F.lit(d) for d in dict.fromkeys(defaults)])
    contained = F.get(F.filter(singleton_names, lambda s: F.contains(directory, s)), F.lit(0))
    # The names are words themselves, so "as a word" is membership in the words of the directory.
    words = F.regexp_extract_all(directory, F.lit(r"\w+"), F.lit(0))
    named = F.get(F.array_intersect(default_names, words), F.lit(0))
    allowed = ~directory.contains(OVERRIDE_NAME_SKIPPED)
    return F.when(allowed, F.coalesce(contained, named, F.lit(""))).otherwise(F.lit(""))


def module_variants(modules: DataFrame, name_col: str, ordinal: str) -> DataFrame:
    """Every lower-cased spelling of a module name with the module it stands for.

    A spelling shared by several modules belongs to the last of them.
    """
    name = F.col(name_col)
    spellings = F.array(
        *[
            F.lower(F.trim(F.replace(name, F.lit(part), F.lit("")) if part else name))
            for part in ("", "prebuilt_", "lib_", "lib")
        ]
    )
    return (
        modules.select(F.explode(F.array_distinct(spellings)).alias("spelling"), name_col, ordinal)
        .groupBy("spelling")
        .agg(F.max_by(name_col, ordinal).alias("override"))
    )


def with_override(files: DataFrame, module_col: str, variants: DataFrame) -> DataFrame:
    """Files with the module they override, or an empty text."""
    keyed = files.withColumn("spelling", F.lower(F.trim(F.col(module_col))))
    return (
        keyed.join(variants, "spelling", "left")
        .withColumn("override", F.coalesce("override", F.lit("")))
        .drop("spelling")
    )
