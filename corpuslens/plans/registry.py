"""Named queries over the given tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import spread, work_root

TABLE_NAMES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


class Tables:
    """The tables of one folder as DataFrames: ``t.documents``, ``t.orders`` and so on."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        work_root(spark)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def spread(self, name: str, *keys: str) -> DataFrame:
        """A table for costly per-row work: over all cores even if it is one file."""
        return spread(getattr(self, name), *keys)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the same query for another engine."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql.strip()
        return build

    return register


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_values(rows) -> str:
    """Rows of texts and numbers for a VALUES list."""
    return ", ".join(
        "(" + ", ".join(sql_text(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows
    )
