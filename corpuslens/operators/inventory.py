"""File inventory: duplicates, counters, matching by content hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import OPTIMISED_SUFFIXES
from ..functions.paths import directory_of, path_prefixes


def duplicate_content(files: DataFrame, hash_col: str, owner_col: str, id_col: str) -> DataFrame:
    """Content hashes that occur with more than one owner.

    Copies are combined per (hash, owner) first, so a hash with very many copies shrinks before it
    is shuffled by hash alone.
    """
    per_owner = files.groupBy(hash_col, owner_col).agg(
        F.count("*").alias("copies"), F.min(id_col).alias("first_id")
    )
    return (
        per_owner.groupBy(hash_col)
        .agg(
            F.sum("copies").alias("copies"),
            F.count("*").alias("owners"),
            F.min("first_id").alias("first_id"),
        )
        .where(F.col("owners") > 1)
    )


def duplicate_groups(files: DataFrame, hash_col: str, id_col: str) -> DataFrame:
    """Content hashes with more than one copy."""
    return (
        files.groupBy(hash_col)
        .agg(F.count("*").alias("copies"), F.min(id_col).alias("first_id"))
        .where(F.col("copies") > 1)
    )


def partition_counters(
    files: DataFrame, keys: Sequence[str], is_app: Column, is_property_file: Column, success: Column
) -> DataFrame:
    """Counts per partition and whether its import succeeded."""
    return files.groupBy(*keys).agg(
        F.count("*").alias("firmware_file_count"),
        F.count_if(is_app).alias("android_app_count"),
        F.count_if(is_property_file).alias("build_prop_count"),
        F.sum("size").alias("total_bytes"),
        F.bool_or(F.coalesce(success, F.lit(False))).alias("is_import_success"),
    )


def import_accepted(counters: DataFrame, firmware_col: str) -> DataFrame:
    """A firmware is accepted if at least one partition succeeded."""
    return counters.groupBy(firmware_col).agg(F.bool_or("is_import_success").alias("accepted"))


def new_by_hash(incoming: DataFrame, stored: DataFrame, hash_col: str) -> DataFrame:
    """Incoming rows whose content is not stored yet."""
    return incoming.join(stored.select(hash_col), hash_col, "left_anti")


def missing_ids(requested: DataFrame, existing: DataFrame, id_col: str) -> DataFrame:
    """Requested ids that do not exist, each once."""
    return requested.select(id_col).subtract(existing.select(id_col))


def not_yet_scanned(rows: DataFrame, references: DataFrame, id_col: str) -> DataFrame:
    """Rows without a reference, each id once."""
    return rows.join(references.select(id_col), id_col, "left_anti").dropDuplicates([id_col])


def first_file_by_hash(apps: DataFrame, files: DataFrame, keys: Sequence[str], file_id: str) -> DataFrame:
    """Every app with the first file of the same content; null where there is none."""
    firsts = files.groupBy(*keys).agg(F.min(file_id).alias(file_id))
    return apps.join(firsts, list(keys), "left")


def files_by_hash(files: DataFrame, wanted: DataFrame, hash_col: str) -> DataFrame:
    """All files whose content hash is asked for, once each however often it is asked for."""
    return files.join(wanted.select(hash_col), hash_col, "left_semi")


def optimised_siblings(apps: DataFrame, files: DataFrame) -> DataFrame:
    """Files that carry optimised code of an app: its name with another suffix, in or below its folder.

    Takes ``apps(app_id, firmware_id, path)`` and ``files(file_id, firmware_id, path)``. Each file
    offers itself to every folder above it, so the match is by equality of (firmware, folder, stem).
    """
    app_stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.apk$", "")
    app_keys = apps.select(
        "app_id", "firmware_id", directory_of("path").alias("folder"), app_stem.alias("stem")
    )
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.coalesce(*[F.when(name.endswith(s), F.lit(s)) for s in OPTIMISED_SUFFIXES])
    offered = (
        files.withColumn("suffix", suffix)
        .where(F.col("suffix").isNotNull())
        .select(
            "file_id",
            "firmware_id",
            "suffix",
            F.expr("substring(element_at(split(path, '/'), -1), 1, "
                   "length(element_at(split(path, '/'), -1)) - length(suffix))").alias("stem"),
            F.explode(F.concat(F.array(F.lit("/")), path_prefixes("path"))).alias("folder"),
        )
    )
    return app_keys.join(offered, ["firmware_id", "folder", "stem"]).select(
        "app_id", "file_id", "suffix"
    )


def apps_of_firmware(apps: DataFrame, firmware_ids: DataFrame, firmware_col: str) -> DataFrame:
    return apps.join(firmware_ids.select(firmware_col), firmware_col, "left_semi")


def requested_apps(app_ids: DataFrame, apps: DataFrame, firmware_ids: DataFrame, app_id: str, firmware_col: str) -> DataFrame:
    """Apps asked for directly or through their firmware, each once."""
    through = apps_of_firmware(apps, firmware_ids, firmware_col).select(app_id)
    return app_ids.select(app_id).union(through).distinct()


def dereference(reports: DataFrame, apps: DataFrame, reference: str, app_id: str) -> DataFrame:
    """Reports with the app they point to; a dangling or missing reference gives nulls."""
    return reports.join(apps, F.col(reference) == F.col(app_id), "left")


def listing(partitions: DataFrame, archives: DataFrame) -> DataFrame:
    """Append partition listings to one listing, each row marked with the list it feeds."""
    return partitions.withColumn("listing", F.lit("firmware")).unionByName(
        archives.withColumn("listing", F.lit("archive"))
    )


def store_key(path: Column) -> Column:
    """The store a firmware lies in: the fifth segment below the root."""
    return F.get(F.split(path, "/"), F.lit(5))


def with_store(firmware: DataFrame, stores: DataFrame, path_col: str) -> DataFrame:
    """Firmware rows with their store setting, joined by the path segment that names it."""
    keyed = firmware.withColumn("store_uuid", store_key(F.col(path_col)))
    return keyed.join(stores, "store_uuid")
