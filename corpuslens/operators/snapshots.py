"""Snapshots: upsert, delete with cascade, and routing of failed rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The next snapshot: changed rows overwrite column by column, null keeps what is there."""
    renamed = changes.select(
        *keys, *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c not in keys]
    )
    joined = current.join(renamed, list(keys), "full_outer")
    columns = [
        F.coalesce(f"_new_{c}", c).alias(c) if c in changes.columns and c not in keys else F.col(c)
        for c in current.columns
    ]
    return joined.select(*columns)


def delete_rows(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The snapshot without the listed ids; null references stay."""
    gone = ids.select(F.col(ids.columns[0]).alias(id_col))
    return df.join(gone, id_col, "left_anti").select(*df.columns)


def delete_cascade(
    tables: Mapping[str, DataFrame],
    parent: str,
    ids: DataFrame,
    id_cols: str | Mapping[str, str],
    cascades: Mapping[str, Mapping[str, str]],
) -> dict[str, DataFrame]:
    """Remove parent rows, the rows of child tables that point to them, and so on down. Other tables are unchanged.

    ``cascades`` gives per parent table its child tables with the column that points to it. A table that
    is reached on several ways loses the rows of all of them. The ids of a table are gathered before
    those of its children are looked for, so cascades must not run in a circle.
    """
    id_of = (lambda name: id_cols) if isinstance(id_cols, str) else id_cols.__getitem__
    gone = {parent: ids.select(F.col(ids.columns[0]).alias("_gone"))}
    conditions: dict[str, list[tuple[str, str]]] = {}
    for table in parents_first(parent, cascades):
        for child, reference in cascades.get(table, {}).items():
            if child not in tables:
                continue
            conditions.setdefault(child, []).append((reference, table))
            if child in cascades:
                found = tables[child].join(gone[table].withColumnRenamed("_gone", reference), reference, "left_semi")
                found = found.select(F.col(id_of(child)).alias("_gone"))
                gone[child] = gone[child].unionByName(found) if child in gone else found
    kept = dict(tables)
    kept[parent] = delete_rows(tables[parent], gone[parent], id_of(parent))
    for child, ways in conditions.items():
        for reference, table in ways:
            kept[child] = delete_rows(kept[child], gone[table], reference)
    return kept


def parents_first(parent: str, cascades: Mapping[str, Mapping[str, str]]) -> list[str]:
    """The tables reached from a parent, each after all tables that point down to it."""
    order: list[str] = []
    open_tables: list[str] = []

    def visit(table: str) -> None:
        if table in open_tables:
            raise ValueError(f"cascades run in a circle at {table!r}")
        if table not in order:
            open_tables.append(table)
            for child in cascades.get(table, {}):
                visit(child)
            open_tables.remove(table)
            order.append(table)

    visit(parent)
    return order[::-1]


def route(df: DataFrame, reasons: Mapping[str, Column]) -> DataFrame:
    """Mark each row with the first reason to turn it away; rows without one are admitted."""
    reason = F.coalesce(*[F.when(condition, F.lit(text)) for text, condition in reasons.items()])
    return df.withColumn("reason", reason).withColumn("admitted", F.col("reason").isNull())


def split_routed(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Admitted rows and quarantined rows."""
    return routed.where("admitted").drop("reason", "admitted"), routed.where(~F.col("admitted"))


def reimport_plan(firmware: DataFrame, stores: DataFrame, ids: DataFrame, id_col: str, path_col: str):
    """What a re-import does: rows to feed to the importer with their store, and the rest of the corpus."""
    from .inventory import with_store

    chosen = firmware.join(ids.select(id_col), id_col, "left_semi")
    return with_store(chosen, stores, path_col), delete_rows(firmware, ids.select(id_col), id_col)
