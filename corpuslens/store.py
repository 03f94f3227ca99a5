"""Tables kept as committed snapshots (S14, S15, S16, J16, D22), and pages of them.

A table is cut into buckets: ranges of its id, each a folder of Parquet files sorted by id. A change rewrites the
buckets it touches, under new names; the others stay as they are. A version is one small file that lists the
folders of all tables, and it is written last, by a move. So a change of several tables, such as a delete
with all that depends on it, is there as a whole or not at all, a run that dies leaves the version before it as it was,
and earlier versions stay readable until ``vacuum``.

Ids are unique, not null, and integers or strings. The driver holds one entry per bucket. One writer works at a time: a commit is
refused if another version has come in between.
"""

from __future__ import annotations

import base64
import json
import math
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import scan, snapshots
from .sources.files import qualified
from .sources.tree import open_folder

BUCKET_ROWS = 1_000_000
TASK_ROWS = 1_000_000  # rows that a task writes, in one bucket or in many
_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above these bits
_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


class Conflict(RuntimeError):
    """Another version was committed since the one a change is based on."""


@dataclass
class Bucket:
    """A range of ids from ``first`` on, below the first id of the next bucket; the first bucket has everything below."""

    first: int | str | None
    path: str
    rows: int


@dataclass
class Table:
    id_col: str
    schema: T.StructType
    bucket_rows: int
    buckets: list[Bucket]

    def to_json(self) -> dict:
        listed = [[b.first, b.path, b.rows] for b in self.buckets]
        return {"id": self.id_col, "schema": self.schema.jsonValue(), "bucket_rows": self.bucket_rows, "buckets": listed}

    @classmethod
    def from_json(cls, value: dict) -> Table:
        return cls(value["id"], T.StructType.fromJson(value["schema"]), value["bucket_rows"], [Bucket(*b) for b in value["buckets"]])


@dataclass
class Change:
    """What a change makes of a table, and how much of it was written anew."""

    table: Table
    rewritten: int


@dataclass
class Page:
    """Rows in id order, a cursor per row in the column ``cursor``, and whether there is more on either side."""

    rows: DataFrame
    has_next: bool
    has_previous: bool
    buckets_read: list[str] = field(default_factory=list)


def cursor_of(value: int | str) -> str:
    return base64.urlsafe_b64encode(json.dumps(value).encode()).decode()


def id_of(cursor: str) -> int | str:
    try:
        value = json.loads(base64.urlsafe_b64decode(cursor.encode()))
    except ValueError as error:
        raise ValueError(f"not a cursor: {cursor!r}") from error
    if isinstance(value, bool) or not isinstance(value, (int, str)):
        raise ValueError(f"not a cursor: {cursor!r}")
    return value


def bucket_of(value: Column, table: Table) -> Column:
    """The number of the bucket an id belongs to."""
    firsts = [b.first for b in table.buckets[1:]]

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        # Strings compare by code points, which is the order of their bytes as well.
        cuts = np.array(firsts, dtype=object if any(isinstance(f, str) for f in firsts) else np.int64)
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(cuts.dtype), side="right").astype(np.int32))

    return place(value) if firsts else F.lit(0)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = qualified(spark, root).rstrip("/")
        self._system, self._top = open_folder(self.root)

    # --- versions --------------------------------------------------------------------------

    def versions(self) -> list[int]:
        found = self._system.get_file_info(pafs.FileSelector(f"{self._top}/versions", allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json"))

    def version(self) -> int:
        """The current version; 0 if nothing was committed yet."""
        return max(self.versions(), default=0)

    def tables(self, version: int | None = None) -> dict[str, Table]:
        version = self.version() if version is None else version
        if version == 0:
            return {}
        with self._system.open_input_stream(f"{self._top}/versions/{version:010d}.json", compression=None) as stream:
            return {name: Table.from_json(value) for name, value in json.loads(stream.read()).items()}

    def _commit(self, base: int, changes: Mapping[str, Change]) -> int:
        if self.version() != base:
            raise Conflict(f"version {self.version()} came after {base}")
        tables = self.tables(base) | {name: change.table for name, change in changes.items()}
        self._system.create_dir(f"{self._top}/versions", recursive=True)
        fresh = f"{self._top}/versions/{uuid.uuid4().hex}.tmp"
        with self._system.open_output_stream(fresh, compression=None) as stream:
            stream.write(json.dumps({name: table.to_json() for name, table in tables.items()}).encode())
        self._system.move(fresh, f"{self._top}/versions/{base + 1:010d}.json")
        return base + 1

    def vacuum(self, keep: int = 2) -> int:
        """Remove all versions but the last ones, and the folders that none of these refer to; how many folders went."""
        kept = self.versions()[-keep:]
        used = {b.path.split("/")[0] for v in kept for table in self.tables(v).values() for b in table.buckets}
        for version in self.versions()[:-keep]:
            self._system.delete_file(f"{self._top}/versions/{version:010d}.json")
        data = self._system.get_file_info(pafs.FileSelector(f"{self._top}/data", allow_not_found=True))
        gone = [f.path for f in data if f.base_name not in used]
        for path in gone:
            self._system.delete_dir(path)
        return len(gone)

    # --- reading ---------------------------------------------------------------------------

    def _quietly(self, listed: Callable[[], DataFrame]) -> DataFrame:
        """Folders are listed by as many tasks as there are cores, and not by one each, whose results all go to the driver."""
        before = self.spark.conf.get(_LISTING_TASKS)
        self.spark.conf.set(_LISTING_TASKS, str(min(int(before), max(2, self.spark.sparkContext.defaultParallelism))))
        try:
            return listed()
        finally:
            self.spark.conf.set(_LISTING_TASKS, before)

    def _read(self, table: Table, buckets: Sequence[Bucket]) -> DataFrame:
        paths = [f"{self.root}/data/{b.path}" for b in buckets if b.rows]
        if not paths:
            return self.spark.createDataFrame([], table.schema)
        return self._quietly(lambda: self.spark.read.schema(table.schema).parquet(*paths))

    def table(self, name: str, version: int | None = None) -> DataFrame:
        table = self.tables(version)[name]
        return self._read(table, table.buckets)

    def page(self, name: str, first: int | None = None, after: str | None = None, last: int | None = None, before: str | None = None,
             filters: Mapping | None = None) -> Page:
        """``first`` rows after a cursor, or ``last`` rows before one, in id order.

        Buckets are read from the cursor on until the page is full, twice as many each time: how much is read depends on
        the page, and with filters on how rare their rows are, not on the table.
        """
        if (first is None) == (last is None):
            raise ValueError("a page has either a first or a last number of rows")
        table, forward = self.tables()[name], last is None
        size, cursor = (first, after) if forward else (last, before)
        if (forward and before is not None) or (not forward and after is not None) or size < 0:
            raise ValueError("first goes with after, last with before, and neither is negative")
        bound = None if cursor is None else id_of(cursor)
        buckets = table.buckets
        if bound is not None:
            place = sum(1 for b in buckets[1:] if b.first <= bound)
            buckets = buckets[place:] if forward else buckets[: place + 1]
        buckets = buckets if forward else buckets[::-1]
        column = F.col(f"`{table.id_col}`")
        read = 1
        while True:
            rows = self._read(table, buckets[:read])
            if bound is not None:
                rows = rows.where(column > bound if forward else column < bound)
            rows = scan.scan(rows, filters=filters)
            found = rows.orderBy(column.asc() if forward else column.desc()).limit(size + 1).collect()
            if len(found) > size or read >= len(buckets):
                break
            read *= 2
        more, chosen = len(found) > size, found[:size]
        chosen = chosen if forward else chosen[::-1]
        schema = T.StructType([*table.schema.fields, T.StructField("cursor", T.StringType())])
        rows = self.spark.createDataFrame([(*r, cursor_of(r[table.id_col])) for r in chosen], schema)
        # With a cursor there is at least the row it names on the other side.
        other = bound is not None
        return Page(rows, more if forward else other, other if forward else more, [b.path for b in buckets[:read]])

    # --- writing ---------------------------------------------------------------------------

    def _write(self, rows: DataFrame, table: Table, parts: int, by: list[str]) -> list[tuple]:
        """Write sorted ranges of ids; ``(bucket, first id, path, rows)`` of each in id order.

        ``parts`` is how many ranges there will be, 0 for one per value of ``by``. Tasks write many small ranges each, so their
        number goes with the rows and not with the ranges.
        """
        folder = uuid.uuid4().hex
        columns = [f"`{c}`" for c in table.schema.names]
        if parts:
            tasks = max(1, min(parts, max(self.spark.sparkContext.defaultParallelism, math.ceil(parts * table.bucket_rows / TASK_ROWS))))
            sorted_rows = rows.repartitionByRange(tasks, *by, table.id_col).sortWithinPartitions(*by, table.id_col)
            # The place of a row in its task, cut into ranges. Rows of one id, should there be several, stay together.
            held = sorted_rows.withColumn("_place", F.monotonically_increasing_id())
            sorted_rows = held.withColumn("_first", F.min("_place").over(Window.partitionBy(*by, f"`{table.id_col}`")))
            local = F.col("_first").bitwiseAND((1 << _ROW_BITS) - 1)
            piece = F.col("_first") - local + F.floor(local / F.lit(table.bucket_rows))
        else:
            sorted_rows, piece = rows.repartition(*by), F.lit(0).cast("long")
        cut = sorted_rows.select(*columns, *[F.col(b).alias("_b") for b in by], piece.alias("_piece"))
        places = [*(["_b"] if by else []), "_piece"]
        cut.sortWithinPartitions(*places, table.id_col).write.partitionBy(*places).parquet(f"{self.root}/data/{folder}")
        # With its schema, also a folder without rows can be read.
        kinds = [T.StructField(c, T.IntegerType() if c == "_b" else T.LongType()) for c in places]
        written = self._quietly(lambda: self.spark.read.schema(T.StructType([*table.schema.fields, *kinds])).parquet(f"{self.root}/data/{folder}"))
        found = written.groupBy((F.col("_b") if by else F.lit(0)).alias("b"), F.col("_piece").alias("p")).agg(F.min(table.id_col).alias("first"), F.count("*").alias("n")).collect()
        path = (lambda r: f"{folder}/_b={r.b}/_piece={r.p}") if by else (lambda r: f"{folder}/_piece={r.p}")
        return sorted(((r.b, r["first"], path(r), r.n) for r in found), key=lambda x: (x[0], x[1]))

    def create(self, name: str, rows: DataFrame, id_col: str, bucket_rows: int = BUCKET_ROWS) -> Change:
        """A new table, or a new start of one."""
        base = self.version()
        kind = rows.schema[id_col].dataType
        if not isinstance(kind, (T.IntegralType, T.StringType)):
            raise ValueError(f"ids of type {kind.simpleString()} cannot be cut into ranges")
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
        table = Table(id_col, schema, bucket_rows, [])
        known = rows.where(F.assert_true(F.col(f"`{id_col}`").isNotNull(), F.lit("an id is null")).isNull())
        found = self._write(known, table, max(1, math.ceil(rows.count() / bucket_rows)), [])
        table.buckets = [Bucket(f if i else None, path, n) for i, (_, f, path, n) in enumerate(found)] or [Bucket(None, "", 0)]
        change = Change(table, len(table.buckets))
        self._commit(base, {name: change})
        return change

    def _rewritten(self, table: Table, touched: Sequence[int], make) -> Change:
        """The table with some buckets replaced by what ``make`` makes of their rows."""
        if not touched:
            return Change(table, 0)
        ids = F.col(f"`{table.id_col}`")
        staged = f"{self.root}/data/{uuid.uuid4().hex}"
        make(self._read(table, [table.buckets[b] for b in touched])).withColumn("_bucket", bucket_of(ids, table)).write.parquet(staged)
        rows = self.spark.read.parquet(staged)
        sizes = {r[0]: r[1] for r in rows.groupBy("_bucket").count().collect()}
        full = [b for b, n in sizes.items() if n > 2 * table.bucket_rows]
        found: list[tuple] = []
        # A bucket that has grown too large is cut into ranges, the others are written as they are.
        if len(full) < len(sizes):
            found += self._write(rows.where(~F.col("_bucket").isin(full)), table, 0, ["_bucket"])
        if full:
            parts = math.ceil(sum(sizes[b] for b in full) / table.bucket_rows)
            found += self._write(rows.where(F.col("_bucket").isin(full)), table, parts, ["_bucket"])
        pieces: dict[int, list[Bucket]] = {}
        for b, first, path, n in sorted(found, key=lambda x: (x[0], x[1])):
            # The lowest piece keeps the bound of its bucket: ids below its first row belong there, too.
            pieces.setdefault(b, []).append(Bucket(first if b in pieces else table.buckets[b].first, path, n))
        buckets: list[Bucket] = []
        for b, bucket in enumerate(table.buckets):
            buckets += pieces.get(b, []) if b in set(touched) else [bucket]
        # What was the second bucket may be the first one now.
        buckets = [Bucket(None if i == 0 else b.first, b.path, b.rows) for i, b in enumerate(buckets)]
        return Change(Table(table.id_col, table.schema, table.bucket_rows, buckets or [Bucket(None, "", 0)]), len(touched))

    def _touched(self, table: Table, ids: DataFrame) -> list[int]:
        return sorted(r[0] for r in ids.select(bucket_of(F.col(f"`{table.id_col}`"), table).alias("b")).distinct().collect())

    def _upserted(self, table: Table, changes: DataFrame) -> Change:
        ids = F.col(f"`{table.id_col}`")
        changes = changes.where(F.assert_true(ids.isNotNull(), F.lit("an id is null")).isNull())
        touched = self._touched(table, changes)
        return self._rewritten(table, touched, lambda old: snapshots.upsert(old, changes, [table.id_col]))

    def _without(self, table: Table, column: str, gone: DataFrame) -> Change:
        """The table without the rows whose column is among the values of a one-column table."""
        values = gone.select(F.col(gone.columns[0]).alias(column))
        hit = self._read(table, table.buckets).select(*{table.id_col, column}).join(values, column, "left_semi")
        return self._rewritten(table, self._touched(table, hit), lambda old: snapshots.delete_rows(old, values, column))

    def upsert(self, name: str, changes: DataFrame) -> Change:
        """New rows come in, known ones are overwritten column by column where the change is not null."""
        base = self.version()
        change = self._upserted(self.tables(base)[name], changes)
        self._commit(base, {name: change})
        return change

    def _deleted(self, base: int, name: str, ids: DataFrame, cascades: Mapping[str, Mapping[str, str]]) -> dict[str, Change]:
        tables = self.tables(base)
        gone = {name: ids.select(F.col(ids.columns[0]).alias("_gone")).distinct()}
        changes = {name: self._without(tables[name], tables[name].id_col, gone[name])}
        for parent in snapshots.parents_first(name, cascades):
            for child, reference in cascades.get(parent, {}).items():
                if child not in tables or parent not in gone:
                    continue
                if child in cascades:
                    found = self._read(tables[child], tables[child].buckets).join(gone[parent].toDF(reference), reference, "left_semi")
                    found = found.select(F.col(tables[child].id_col).alias("_gone"))
                    gone[child] = (gone[child].unionByName(found) if child in gone else found).distinct()
                before = changes[child] if child in changes else Change(tables[child], 0)
                after = self._without(before.table, reference, gone[parent])
                changes[child] = Change(after.table, before.rewritten + after.rewritten)
        return changes

    def delete(self, name: str, ids: DataFrame, cascades: Mapping[str, Mapping[str, str]] | None = None) -> dict[str, Change]:
        """Rows go, and with them the rows of other tables that point to them, in one version."""
        base = self.version()
        changes = self._deleted(base, name, ids, cascades or {})
        self._commit(base, changes)
        return changes

    def admit(self, name: str, rows: DataFrame, reasons: Mapping[str, Column], quarantine: str = "quarantine") -> dict[str, Change]:
        """Rows without a reason against them come in; the others go to the quarantine with the first reason,
        and leave it once they are admitted, all in one version (S16)."""
        base = self.version()
        tables = self.tables(base)
        staged = f"{self.root}/data/{uuid.uuid4().hex}"
        snapshots.route(rows, reasons).write.parquet(staged)
        routed = self.spark.read.parquet(staged)
        admitted, rejected = snapshots.split_routed(routed)
        rejected = rejected.drop("admitted")
        table = tables[name]
        aside = tables.get(quarantine) or Table(table.id_col, rejected.schema, table.bucket_rows, [Bucket(None, "", 0)])
        aside = self._without(aside, aside.id_col, admitted.select(table.id_col)).table
        changes = {name: self._upserted(table, admitted), quarantine: self._upserted(aside, rejected)}
        self._commit(base, changes)
        return changes

    def reimport(self, name: str, ids: DataFrame, stores: DataFrame, path_col: str, cascades: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
        """Rows leave the corpus with all that depends on them and are given back, with their store, for a new import."""
        base = self.version()
        table = self.tables(base)[name]
        feed, _ = snapshots.reimport_plan(self.table(name, base), stores, ids, table.id_col, path_col)
        self._commit(base, self._deleted(base, name, ids, cascades or {}))
        return feed
