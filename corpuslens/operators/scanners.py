"""Scan jobs: protocol, registry, isolation of failures, empty reports, arguments."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..catalog import RULE_SCAN_MAX_BYTES

STATUS_COMPLETED, STATUS_FAILED = "completed", "failed"
SLICE_BYTES = 4 << 20  # content that a batch scan looks at together


class Scanner(Protocol):
    """What a scan job provides: a name, a version, the schema of its result, and a scan of one item."""

    name: str
    version: str
    result_schema: T.StructType

    def scan(self, content: bytes, **arguments: Any) -> Mapping[str, Any]: ...


_REGISTRY: dict[str, Callable[[], Scanner]] = {}


def register_scanner(name: str, factory: Callable[[], Scanner]) -> None:
    _REGISTRY[name] = factory


def scanner_names() -> list[str]:
    return sorted(_REGISTRY)


def find_scanner(name: str) -> Scanner:
    if name not in _REGISTRY:
        raise ValueError(f"unknown scanner {name!r}; known: {', '.join(scanner_names())}")
    return _REGISTRY[name]()


def empty_result(schema: T.StructType) -> dict[str, Any]:
    """What a report holds after a failed scan: an empty value of the right kind for every field."""
    empty = {T.StringType: "", T.BooleanType: False, T.ArrayType: [], T.MapType: {}}
    return {f.name: empty.get(type(f.dataType)) for f in schema.fields}


def report_schema(scanner: Scanner, id_field: T.StructField) -> T.StructType:
    header = [
        T.StructField(id_field.name, id_field.dataType),
        T.StructField("scanner_name", T.StringType()),
        T.StructField("scanner_version", T.StringType()),
        T.StructField("scan_status", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
    return T.StructType(header + scanner.result_schema.fields)


def run_scanner(
    items: DataFrame, scanner: str | Scanner, id_col: str, content_col: str, arguments: Mapping[str, Any] | None = None
) -> DataFrame:
    """One report row per item. A scan that raises gives a failed row with the error; the job goes on.

    Items are scanned in Arrow batches where they are; nothing is shuffled. A scanner with ``scan_batch`` gets
    contents of some megabytes at once; other scanners get one item after the other. ``operators.isolated`` has deadlines.
    """
    job = find_scanner(scanner) if isinstance(scanner, str) else scanner
    schema = report_schema(job, items.schema[id_col])
    extra = dict(arguments or {})
    picked = items.select(id_col, F.col(content_col).cast("binary").alias(content_col))
    if hasattr(job, "scan_batch"):
        return picked.mapInArrow(_whole_batches(job, schema, extra), schema)
    return picked.mapInPandas(_single_items(job, schema, extra, id_col, content_col), schema)


def _single_items(job: Scanner, schema: T.StructType, extra: Mapping[str, Any], id_col: str, content_col: str):
    blank, names = empty_result(job.result_schema), schema.names

    def scan_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, content in zip(batch[id_col], batch[content_col]):
                status, error, result = STATUS_COMPLETED, None, blank
                try:
                    result = job.scan(bytes(content), **extra)
                except Exception as failure:  # one bad item must not fail the task
                    status, error = STATUS_FAILED, str(failure)
                rows.append([item, job.name, job.version, status, error, *(result.get(k) for k in names[5:])])
            yield pd.DataFrame(rows, columns=names)

    return scan_batches


def _slices(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in pieces of some bytes of content; a larger item is a piece by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _whole_batches(job: Scanner, schema: T.StructType, extra: Mapping[str, Any]):
    target = to_arrow_schema(schema)
    blank = empty_result(job.result_schema)

    def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in _slices(whole, SLICE_BYTES)):
            found, error = job.scan_batch(batch.column(1), **extra)
            failed = error.is_valid()
            repeat = lambda value, kind: pa.array([value] * batch.num_rows, kind)
            status = pc.if_else(failed, STATUS_FAILED, STATUS_COMPLETED)
            columns = [batch.column(0), repeat(job.name, pa.string()), repeat(job.version, pa.string()), status, error]
            for field in job.result_schema.fields:
                kind = target.field(field.name).type
                columns.append(pc.if_else(failed, pa.scalar(blank[field.name], kind), found[field.name].cast(kind)))
            yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, target)], schema=target)

    return scan_batches


def size_gate(size: Column, limit: int = RULE_SCAN_MAX_BYTES) -> Column:
    """Status an item gets before a scan with a size limit: over the limit it fails unscanned."""
    return F.when(size <= limit, F.lit("pending")).otherwise(F.lit(STATUS_FAILED))


def _texts(contents: pa.Array, error: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Contents as texts, with an error where one is none."""
    texts, errors = [], error.to_pylist()
    for at, content in enumerate(contents.to_pylist()):
        try:
            texts.append(None if content is None else content.decode("utf-8"))
        except UnicodeDecodeError as failure:
            texts.append(None)
            errors[at] = errors[at] or str(failure)
    return pa.array(texts, pa.string()), pa.array(errors, pa.string())


class TextScanner:
    """Counts lines and words of UTF-8 text; other content fails. The template for scanners of one's own."""

    name = "TEXT"
    version = "1"
    result_schema = T.StructType(
        [T.StructField("n_lines", T.LongType()), T.StructField("n_words", T.LongType())]
    )

    def scan(self, content: bytes, min_bytes: int = 0) -> dict[str, int]:
        if len(content) < min_bytes:
            raise ValueError(f"content is shorter than {min_bytes} bytes")
        text = content.decode("utf-8")
        return {"n_lines": text.count("\n") + 1, "n_words": len(text.split())}

    def scan_batch(self, contents: pa.Array, min_bytes: int = 0) -> tuple[dict[str, pa.Array], pa.Array]:
        """The results of a batch by field, and the errors of its items, null where there is none."""
        short = pc.less(pc.fill_null(pc.binary_length(contents), 0), min_bytes)
        error = pc.if_else(short, f"content is shorter than {min_bytes} bytes", pa.scalar(None, pa.string()))
        error = pc.if_else(contents.is_null(), "no content", error)
        try:
            text = contents.cast(pa.string())
        except pa.ArrowInvalid:  # some item is no text: only then the items are looked at one by one
            text, error = _texts(contents, error)
        words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(text))
        # A blank text splits into one empty word.
        n_words = pc.if_else(pc.equal(pc.utf8_length(pc.utf8_trim_whitespace(text)), 0), 0, pc.list_value_length(words))
        return {"n_lines": pc.add(pc.count_substring(text, "\n"), 1), "n_words": n_words}, error


class FlagScanner:
    """Finds markers in the raw bytes and returns them as a list."""

    name = "MARKERS"
    version = "1"
    result_schema = T.StructType(
        [T.StructField("main_marker", T.StringType()), T.StructField("markers", T.ArrayType(T.StringType()))]
    )

    def scan(self, content: bytes, markers: tuple[str, ...] = ("token =", "License", "@")) -> dict[str, Any]:
        found = [m for m in markers if m.encode() in content]
        if not found:
            raise ValueError("no marker found")
        return {"main_marker": found[0], "markers": found}


register_scanner(TextScanner.name, TextScanner)
register_scanner(FlagScanner.name, FlagScanner)


def pending_scans(items: DataFrame, reports: DataFrame, id_col: str, scanner: str) -> DataFrame:
    """Items without a report of the scanner, as queued scan rows."""
    from .inventory import not_yet_scanned

    done = reports.where(F.col("scanner_name") == scanner) if "scanner_name" in reports.columns else reports
    return not_yet_scanned(items, done, id_col).select(
        id_col, F.lit(scanner).alias("scanner_name"), F.lit("queued").alias("status")
    )


def job_records(
    jobs: DataFrame, queue: str | None = None, ids: list | None = None, status: str | None = None, id_col: str = "job_id"
) -> DataFrame:
    """Job records by optional queue, id list and status."""
    rows = jobs
    if queue is not None:
        rows = rows.where(F.col("queue") == queue)
    if ids:
        rows = rows.where(F.col(id_col).isin(list(ids)))
    if status is not None:
        rows = rows.where(F.col("status") == status)
    return rows
