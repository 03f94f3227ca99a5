"""Scans in a child process of the task, with a deadline per item.

A scanner may hang, run out of memory or take its process down. Here that costs one item: each task scans in a child process and
watches it. An item that is not done in time, or whose scan ends the child, gives a failed report; the next
item gets a new child. Items over a size limit fail unscanned, and their content is not even sent.
"""

from __future__ import annotations

import multiprocessing
import time
from collections.abc import Iterator, Mapping
from multiprocessing.connection import Connection
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scanners import STATUS_COMPLETED, STATUS_FAILED, Scanner, empty_result, find_scanner, report_schema

SECONDS = 120.0
_STOP_SECONDS = 5.0


def _serve(job: Scanner, connection: Connection) -> None:
    """The child: scans what it is sent until there is nothing more."""
    while True:
        try:
            content, arguments = connection.recv()
        except EOFError:
            return
        try:
            answer = (STATUS_COMPLETED, None, dict(job.scan(content, **arguments)))
        except Exception as failure:  # one bad item must not fail the task
            answer = (STATUS_FAILED, str(failure), None)
        connection.send(answer)


class Watched:
    """A child process that scans one item at a time."""

    def __init__(self, job: Scanner):
        self._job, self._process, self._connection = job, None, None

    def _start(self) -> None:
        context = multiprocessing.get_context("fork")
        self._connection, theirs = context.Pipe()
        self._process = context.Process(target=_serve, args=(self._job, theirs), daemon=True)
        self._process.start()
        theirs.close()  # so that the end of the child is seen here

    def stop(self) -> None:
        if self._process is not None:
            self._connection.close()
            self._process.kill()
            self._process.join(_STOP_SECONDS)
            self._process = None

    def scan(self, content: bytes, arguments: Mapping[str, Any], seconds: float) -> tuple[str, str | None, dict | None]:
        """``(status, error, result)`` of one item."""
        if self._process is None:
            self._start()
        try:
            self._connection.send((content, dict(arguments)))
            if self._connection.poll(seconds):
                return self._connection.recv()
            error = f"took longer than {seconds:g} seconds"
        except (EOFError, OSError):
            self._process.join(_STOP_SECONDS)
            error = f"the scan ended its process with {self._process.exitcode}"
        self.stop()
        return STATUS_FAILED, error, None


def run_isolated(
    items: DataFrame, scanner: str | Scanner, id_col: str, content_col: str, arguments: Mapping[str, Any] | None = None,
    seconds: float = SECONDS, seconds_col: str | None = None, max_bytes: int | None = None, arguments_col: str | None = None,
) -> DataFrame:
    """One report row per item, as ``run_scanner`` gives them, with the seconds each scan took.

    ``seconds_col`` has limits of single items (null: ``seconds``), ``arguments_col`` a map of arguments of single items,
    which win over those of all.
    """
    job = find_scanner(scanner) if isinstance(scanner, str) else scanner
    schema = report_schema(job, items.schema[id_col]).add("scan_seconds", "double")
    blank, names, extra = empty_result(job.result_schema), schema.names, dict(arguments or {})
    content = F.col(f"`{content_col}`").cast("binary")
    fits = F.lit(True) if max_bytes is None else F.coalesce(F.octet_length(content), F.lit(0)) <= max_bytes
    limit = F.lit(float(seconds)) if seconds_col is None else F.coalesce(F.col(f"`{seconds_col}`").cast("double"), F.lit(float(seconds)))
    own = F.lit(None).cast("map<string,string>") if arguments_col is None else F.col(f"`{arguments_col}`")
    picked = items.select(
        F.col(f"`{id_col}`").alias("item"), F.when(fits, content).alias("content"), fits.alias("fits"),
        limit.alias("seconds"), own.alias("arguments"),
    )

    def scan_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        child = Watched(job)
        try:
            for batch in batches:
                rows = []
                for item, content, fits, seconds, own in batch.itertuples(index=False):
                    began = time.monotonic()
                    if not fits:
                        status, error, result = STATUS_FAILED, f"larger than {max_bytes} bytes", None
                    elif content is None:
                        status, error, result = STATUS_FAILED, "no content", None
                    else:
                        status, error, result = child.scan(bytes(content), extra | dict(own or {}), seconds)
                    result = blank if result is None else result
                    rows.append([item, job.name, job.version, status, error, *(result.get(k) for k in names[5:-1]), time.monotonic() - began])
                yield pd.DataFrame(rows, columns=names)
        finally:
            child.stop()

    return picked.mapInPandas(scan_batches, schema)
