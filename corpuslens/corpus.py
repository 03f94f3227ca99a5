"""The list queries over a corpus: one table per collection, below a root folder or as a view."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from .catalog import REPORT_TYPES
from .operators import inventory, reports, scan, snapshots
from .operators.scanners import job_records
from .schemas import CASCADES, schema_of


class Corpus:
    """Opens tables and answers the list queries. Every result is a lazy DataFrame.

    Tables lie below ``root``, or are views over tables that lie elsewhere: filters and columns of a list query then reach
    the scans of these.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, views: Mapping[str, DataFrame] | None = None):
        self.spark = spark
        self.root = None if root is None else root.rstrip("/")
        self.views = dict(views or {})

    def table(self, name: str) -> DataFrame:
        if name in self.views:
            return self.views[name]
        if self.root is None:
            raise ValueError(f"this corpus has no table {name!r}")
        return self.spark.read.schema(schema_of(name)).parquet(f"{self.root}/{name}")

    def list(
        self,
        name: str,
        ids: Sequence[str] | DataFrame | None = None,
        filters: Mapping | None = None,
        columns: Sequence[str] | None = None,
    ) -> DataFrame:
        """The list query every collection has: optional ids, equality filters, projection."""
        return scan.scan(self.table(name), ids=ids, filters=filters, columns=columns)

    def firmware_ids(self, filters: Mapping | None = None) -> DataFrame:
        return self.list("android_firmware", filters=filters, columns=["id"])

    def firmware_page(self, after: str | None, rows: int) -> DataFrame:
        return scan.keyset_page(self.table("android_firmware"), "id", after, rows)

    def app_ids(self, firmware_ids: Sequence[str] | DataFrame | None = None, filters: Mapping | None = None) -> DataFrame:
        """Ids of the apps of the given firmware, or of all apps."""
        apps = self.list("android_app", filters=filters)
        if firmware_ids is not None and (isinstance(firmware_ids, DataFrame) or len(firmware_ids) > 0):
            apps = scan.with_ids(apps, firmware_ids, "firmware_id_reference")
        return apps.select("id")

    def property_files(
        self,
        ids: Sequence[str] | DataFrame | None = None,
        filters: Mapping | None = None,
        keys: Sequence[str] | None = None,
        values: Sequence[str] | None = None,
        distinct_on: str | None = None,
    ) -> DataFrame:
        """Property files that hold all the keys and any of the values, the first one per ``distinct_on``."""
        rows = self.list("build_prop_file", ids=ids, filters=filters)
        if keys:
            rows = rows.where(scan.has_all_keys("properties", keys))
        if values:
            rows = rows.where(scan.has_any_value("properties", values))
        return scan.distinct_on(rows, distinct_on, "id") if distinct_on else rows

    def scan_reports(
        self,
        ids: Sequence[str] | DataFrame | None = None,
        filters: Mapping | None = None,
        requested: Sequence[str] | None = None,
    ) -> DataFrame:
        """Reports of all types, or of the requested ones, which are then the only ones read."""
        chosen = [name for name in REPORT_TYPES if requested is None or name in requested]
        return reports.union_reports({name: self.list(name, ids=ids, filters=filters) for name in chosen})

    def reports_with_apps(self, name: str) -> DataFrame:
        """Reports with the app they refer to."""
        apps = self.table("android_app").select("id", "filename", "packagename", "firmware_id_reference")
        renamed = apps.toDF("app_id", "app_filename", "app_packagename", "app_firmware_id")
        return inventory.dereference(self.table(name), renamed, "android_app_id_reference", "app_id")

    def jobs(self, queue: str | None = None, ids: Sequence[str] | None = None, status: str | None = None) -> DataFrame:
        return job_records(self.table("rq_job"), queue, list(ids or []), status)

    def without(self, parent: str, ids: DataFrame, present: Sequence[str] | None = None) -> dict[str, DataFrame]:
        """The tables as they are after deleting rows of a parent table with all that depends on them.

        ``present`` names the tables that the corpus has, if not all.
        """
        names = [parent]
        for name in names:
            names += [child for child in CASCADES.get(name, {}) if child not in names]
        tables = {name: self.table(name) for name in names if present is None or name in present}
        return snapshots.delete_cascade(tables, parent, ids, "id", CASCADES)
