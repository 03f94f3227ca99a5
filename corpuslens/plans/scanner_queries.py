"""Scan jobs over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scanners as sc
from ..operators.isolated import run_isolated
from .registry import Tables, query

WORDS_SQL = r"len(regexp_extract_all(text, '\S+'))"
LINES_SQL = "len(string_split(text, chr(10)))"


@query(
    "scanner_map",
    f"SELECT doc_id, 'TEXT' AS scanner_name, 'completed' AS scan_status, {LINES_SQL} AS n_lines, {WORDS_SQL} AS n_words FROM documents",
)
def scanner_map(t: Tables) -> DataFrame:
    reports = sc.run_scanner(t.spread("documents", "doc_id"), "TEXT", "doc_id", "text")
    return reports.select("doc_id", "scanner_name", "scan_status", "n_lines", "n_words")


@query(
    "scanner_args",
    f"""
    SELECT doc_id, CASE WHEN strlen(text) < 500 THEN 'failed' ELSE 'completed' END AS scan_status,
      CASE WHEN strlen(text) < 500 THEN 'content is shorter than 500 bytes' END AS error,
      CASE WHEN strlen(text) >= 500 THEN {LINES_SQL} END AS n_lines FROM documents
    """,
)
def scanner_args(t: Tables) -> DataFrame:
    reports = sc.run_scanner(t.spread("documents", "doc_id"), "TEXT", "doc_id", "text", {"min_bytes": 500})
    return reports.select("doc_id", "scan_status", "error", "n_lines")


MARKED_SQL = "(text LIKE '%token =%' OR text LIKE '%License%' OR text LIKE '%@%')"


@query("failure_rows", f"SELECT doc_id, 'no marker found' AS error FROM documents WHERE NOT {MARKED_SQL}")
def failure_rows(t: Tables) -> DataFrame:
    reports = sc.run_scanner(t.spread("documents", "doc_id"), "MARKERS", "doc_id", "text")
    return reports.where(F.col("scan_status") == sc.STATUS_FAILED).select("doc_id", "error")


@query(
    "empty_reports",
    f"""
    SELECT doc_id, CASE WHEN NOT {MARKED_SQL} THEN '' WHEN text LIKE '%token =%' THEN 'token =' WHEN text LIKE '%License%' THEN 'License' ELSE '@' END AS main_marker,
      (text LIKE '%token =%')::INT + (text LIKE '%License%')::INT + (text LIKE '%@%')::INT AS marker_count FROM documents
    """,
)
def empty_reports(t: Tables) -> DataFrame:
    reports = sc.run_scanner(t.spread("documents", "doc_id"), "MARKERS", "doc_id", "text")
    return reports.select("doc_id", "main_marker", F.size("markers").alias("marker_count"))


@query(
    "isolated_scan",
    f"""
    SELECT doc_id, CASE WHEN strlen(text) > 12000 THEN 'failed' ELSE 'completed' END AS scan_status,
      CASE WHEN strlen(text) > 12000 THEN 'larger than 12000 bytes' END AS error,
      CASE WHEN strlen(text) <= 12000 THEN {WORDS_SQL} END AS n_words FROM documents
    """,
)
def isolated_scan(t: Tables) -> DataFrame:
    """Scans in child processes with a deadline; items over the size limit fail unscanned."""
    reports = run_isolated(t.spread("documents", "doc_id"), "TEXT", "doc_id", "text", max_bytes=12000)
    return reports.select("doc_id", "scan_status", "error", "n_words")


@query(
    "scanner_registry",
    """
    SELECT n.name AS scanner_name, count(*) AS pending FROM documents CROSS JOIN (VALUES ('MARKERS'), ('TEXT')) n(name)
    WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1
    """,
)
def scanner_registry(t: Tables) -> DataFrame:
    """Pending scans per registered scanner; one unfolding of each item, no join."""
    open_items = sc.pending_scans(t.documents.select("doc_id"), t.labels, "doc_id", "any")
    names = F.array(*[F.lit(n) for n in sc.scanner_names()])
    return open_items.select(F.explode(names).alias("scanner_name")).groupBy("scanner_name").agg(F.count("*").alias("pending"))


@query(
    "pending_scans",
    "SELECT doc_id, 'TEXT' AS scanner_name, 'queued' AS status FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def pending_scans(t: Tables) -> DataFrame:
    return sc.pending_scans(t.documents.select("doc_id"), t.labels, "doc_id", "TEXT")
