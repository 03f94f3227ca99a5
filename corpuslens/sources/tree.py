"""Folders as a data source, in batch and as a stream.

``spark.read.format("file_tree")`` lists a tree: planning goes down a few levels until there are enough folders
to share out, and each task walks the folders it is given. ``spark.readStream.format("file_tree")`` gives the files that
have not been given before. Its offset is the number of the last entry of a log of new files, so an offset stays
as small as it is, a batch reads its own entries only, and a restart gives the same batches.

Options: ``path``, a folder with its file system (``files.qualified`` adds it); ``recursive`` (true);
``glob``, a pattern that file names have to match; ``folders``, how many folders planning looks for (256);
``log``, for streams, the folder of the log, which belongs to the stream like its checkpoint.

Hidden names, empty files and empty folders are rows like all others. Folders that are links are listed, not
entered. A file counts as new again once its size or time differs.
"""

from __future__ import annotations

import fnmatch
import json
import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "file_tree"
LISTED_DDL = "path string, is_directory boolean, size long, modified timestamp"
_LISTED = pa.schema(
    [("path", pa.string()), ("is_directory", pa.bool_()), ("size", pa.int64()), ("modified", pa.timestamp("us", tz="UTC"))]
)
PLANNED_FOLDERS = 256
BATCH_ROWS = 10_000
LOG_ROWS = 2_000  # new files per file of the log, and so per input partition of a stream
_DIGEST = 16


def open_folder(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system a folder is in, and the folder's path there."""
    if root.startswith("/"):
        return pafs.LocalFileSystem(), root
    if root.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + root[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(root)


@dataclass
class Folders(InputPartition):
    """Folders of one task; deep ones are walked, of the others only the direct content is listed."""

    paths: list[str]
    deep: bool

    def __init__(self, paths: list[str], deep: bool):
        self.paths, self.deep = paths, deep


@dataclass
class LogRows(InputPartition):
    """One file of the rows of an entry of a stream's log."""

    name: str

    def __init__(self, name: str):
        self.name = name


class Lister:
    """What lies in folders of one file system."""

    def __init__(self, root: str, glob: str | None = None):
        self.system, top = open_folder(root)
        self.top = top.rstrip("/") or "/"
        self._local, self._glob = isinstance(self.system, pafs.LocalFileSystem), glob

    def content(self, folder: str) -> tuple[list[pafs.FileInfo], list[str]]:
        """The entries of a folder that count, and its folders to enter."""
        found = self.system.get_file_info(pafs.FileSelector(folder))
        folders = [f for f in found if f.type == pafs.FileType.Directory]
        enter = [f.path for f in folders if not (self._local and os.path.islink(f.path))]
        if self._glob is not None:
            found = [f for f in found if f.type == pafs.FileType.Directory or fnmatch.fnmatchcase(f.base_name, self._glob)]
        return found, enter

    def walk(self, folders: list[str], deep: bool) -> Iterator[list[pafs.FileInfo]]:
        left = list(folders)
        while left:
            found, enter = self.content(left.pop())
            if deep:
                left += enter
            yield found


def _time(info: pafs.FileInfo):
    return None if info.mtime_ns is None else info.mtime_ns // 1000


def _batch(found: list[pafs.FileInfo]) -> pa.RecordBatch:
    folder = [f.type == pafs.FileType.Directory for f in found]
    columns = [[f.path for f in found], folder, [None if d else f.size for f, d in zip(found, folder)], [_time(f) for f in found]]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _LISTED)], schema=_LISTED)


class TreeReader(DataSourceReader):
    def __init__(self, path: str, recursive: bool, glob: str | None, folders: int):
        self.path, self.recursive, self.glob, self.folders = path, recursive, glob, folders

    def partitions(self) -> list[InputPartition]:
        """Levels are opened until enough folders are found; opened ones are listed flat, the rest walked."""
        lister = Lister(self.path)
        if not self.recursive:
            return [Folders([lister.top], False)]
        opened, frontier = [], [lister.top]
        with ThreadPoolExecutor(16) as pool:
            while frontier and len(frontier) < self.folders:
                opened += frontier
                frontier = [f for _, enter in pool.map(lister.content, frontier) for f in enter]
        flat = [Folders(opened[i :: self.folders], False) for i in range(min(len(opened), self.folders))]
        return flat + [Folders([folder], True) for folder in frontier]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        held: list[pafs.FileInfo] = []
        for found in Lister(self.path, self.glob).walk(partition.paths, partition.deep):
            held += found
            whole = len(held) // BATCH_ROWS * BATCH_ROWS
            for at in range(0, whole, BATCH_ROWS):
                yield _batch(held[at : at + BATCH_ROWS])
            held = held[whole:]
        yield _batch(held)


def _digest(info: pafs.FileInfo) -> bytes:
    return blake2b(f"{info.path}\0{info.size}\0{info.mtime_ns}".encode("utf-8", "surrogateescape"), digest_size=_DIGEST).digest()


def _digests(values: list[bytes]) -> np.ndarray:
    return np.array(values, dtype=f"S{_DIGEST}")


class Log:
    """Entries 1, 2, 3 ... of a stream: the files that were new at one look at the folder.

    An entry's rows are in files of ``LOG_ROWS`` each. Its head, which lists them, is written last, under another name,
    and moved, so an entry is there as a whole or not at all.
    """

    def __init__(self, folder: str):
        self.system, self.top = open_folder(folder)

    def _read(self, name: str) -> list:
        with self.system.open_input_stream(f"{self.top}/{name}", compression=None) as stream:
            return json.loads(stream.read())

    def _write(self, name: str, content: list) -> None:
        with self.system.open_output_stream(f"{self.top}/{name}", compression=None) as stream:
            stream.write(json.dumps(content).encode())

    def entries(self) -> int:
        found = self.system.get_file_info(pafs.FileSelector(self.top, allow_not_found=True))
        return max((int(f.base_name[:-5]) for f in found if f.base_name.endswith(".head")), default=0)

    def parts(self, entry: int) -> list[str]:
        return self._read(f"{entry:012d}.head")

    def rows(self, part: str) -> list[list]:
        return self._read(part)

    def append(self, entry: int, rows: list[list]) -> None:
        self.system.create_dir(self.top, recursive=True)
        own = uuid.uuid4().hex
        parts = [f"{entry:012d}-{own}-{at}.rows" for at in range(0, len(rows), LOG_ROWS)]
        for part, at in zip(parts, range(0, len(rows), LOG_ROWS)):
            self._write(part, rows[at : at + LOG_ROWS])
        self._write(f"{own}.tmp", parts)
        self.system.move(f"{self.top}/{own}.tmp", f"{self.top}/{entry:012d}.head")


class TreeStreamReader(DataSourceStreamReader):
    """The driver keeps 16 bytes for each file given so far; everything else about files is in the log."""

    def __init__(self, path: str, recursive: bool, glob: str | None, log: str):
        self.path, self.recursive, self.glob, self.log = path, recursive, glob, log
        self._seen: np.ndarray | None = None
        self._last = 0

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def _load(self, log: Log) -> None:
        self._last = log.entries()
        parts = [part for entry in range(1, self._last + 1) for part in log.parts(entry)]
        known = [_digests([bytes.fromhex(row[3]) for row in log.rows(part)]) for part in parts]
        self._seen = np.sort(np.concatenate([_digests([]), *known]))

    def _new(self, found: list[pafs.FileInfo]) -> list[list]:
        """Rows ``[path, size, time, digest]`` of the files that were not there before."""
        files = [f for f in found if f.type != pafs.FileType.Directory]
        digests = [_digest(f) for f in files]
        at = np.searchsorted(self._seen, _digests(digests))
        known = [i < len(self._seen) and self._seen[i] == d for i, d in zip(at.tolist(), _digests(digests))]
        return [[f.path, f.size, _time(f), d.hex()] for f, d, old in zip(files, digests, known) if not old]

    def latestOffset(self) -> dict:
        log, lister = Log(self.log), Lister(self.path, self.glob)
        if self._seen is None:
            self._load(log)
        rows = [row for found in lister.walk([lister.top], self.recursive) for row in self._new(found)]
        if rows:
            rows.sort()
            log.append(self._last + 1, rows)
            self._last += 1
            self._seen = np.sort(np.concatenate([self._seen, _digests([bytes.fromhex(row[3]) for row in rows])]))
        return {"entry": self._last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        log = Log(self.log)
        return [LogRows(part) for entry in range(start["entry"] + 1, end["entry"] + 1) for part in log.parts(entry)]

    def read(self, partition: LogRows) -> Iterator[pa.RecordBatch]:
        rows = Log(self.log).rows(partition.name)
        columns = [[r[0] for r in rows], [False] * len(rows), [r[1] for r in rows], [r[2] for r in rows]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _LISTED)], schema=_LISTED)


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LISTED_DDL

    def _arguments(self) -> tuple[str, bool, str | None]:
        return self.options["path"], self.options.get("recursive", "true").lower() == "true", self.options.get("glob")

    def reader(self, schema: StructType) -> DataSourceReader:
        return TreeReader(*self._arguments(), int(self.options.get("folders", PLANNED_FOLDERS)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        if "log" not in self.options:
            raise ValueError("a stream of files needs the folder of its log as option 'log'")
        return TreeStreamReader(*self._arguments(), self.options["log"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileTree)
