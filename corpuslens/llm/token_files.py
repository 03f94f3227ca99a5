"""Tokenised corpora as binary files, by a data source of their own (operator 13).

``write_tokens`` encodes every text, appends the end id, sorts documents by id over range partitions and writes
one file of directly addressable codes (``token_codes``) per partition; ``read_tokens`` gives the documents back, with
the number of ids before each. ``TokenCorpus`` reads any id or stretch of the corpus without decoding anything else.

Tasks write files under names that no other attempt uses. What they hold becomes part of the corpus when the driver
writes the manifest, at the end of a write in which all tasks succeeded: it lists the files in order, with the number
of ids before each, so files of lost or repeated attempts are never read. The manifest has one entry per file.

Cases: null and empty texts hold the end id only; special tokens inside a text are one id each, as the library has
them by default; a null id comes first; rows of one id are ordered by their texts' hashes; a very long
text is written segment by segment; an empty table is a corpus without ids.
"""

from __future__ import annotations

import json
import uuid
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import work_root
from ..sources.files import open_folder, qualified
from .common import byte_values, sliced, text_key, text_rows
from .pretokens import letters_of, read_file, splitter
from .token_codes import FileWriter, TokenFile
from .token_counts import WORD_PATTERN

END_ID = 1
FORMAT = "token_codes"
MANIFEST = "manifest.json"
CACHED_WORDS, CACHED_PIECES = 250_000, 120_000  # entries of a generation
CACHED_LETTERS = 128
_UNORDERED = "rows have to come in the order of their ids"

DOCUMENTS_DDL = "doc_id long, start long, n_tokens long, ids binary"
_DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
_ENCODED = pa.schema([("id", pa.int64()), ("ids", pa.binary())])


class Recent:
    """Ids by text, of the texts met lately: two generations, of which the older goes when the younger is full."""

    def __init__(self, size: int):
        self._size = size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, text: str) -> bytes | None:
        """What is remembered, also of the older generation."""
        ids = self.young.get(text)
        if ids is None and (ids := self.old.get(text)) is not None:
            self.put(text, ids)
        return ids

    def put(self, text: str, ids: bytes) -> None:
        if len(text) <= CACHED_LETTERS:
            if len(self.young) >= self._size:
                self.old, self.young = self.young, {}
            self.young[text] = ids


class Encoder:
    """Texts to ids, as unsigned 32-bit little-endian numbers in a row.

    No pre-token of this kind of vocabulary spans white space, so what stands between white space is looked up as a
    whole; where it is new, its pre-tokens are.
    """

    def __init__(self, content: str, pattern: str):
        self._split = splitter(content, pattern)
        self._tokenize = self._split.tokenizer.model.tokenize
        self._special = {token: i.to_bytes(4, "little") for token, i in self._split.special.items()}
        self._words, self._pieces = Recent(CACHED_WORDS), Recent(CACHED_PIECES)

    def _piece(self, piece: str) -> bytes:
        ids = self._pieces.get(piece)
        if ids is None:
            ids = self._ids(piece)
            self._pieces.put(piece, ids)
        return ids

    def _ids(self, piece: str) -> bytes:
        # Visible ASCII characters stand for themselves in byte-level vocabularies.
        letters = piece if piece.isascii() and piece.isprintable() else letters_of(piece.encode())
        return array("I", [t.id for t in self._tokenize(letters)]).tobytes()

    def _word(self, word: str) -> bytes:
        words = self._words
        ids = words.young.get(word) or words.old.get(word)
        if ids is None:
            pieces = self._split.sure_pieces(word)
            # A word that is one piece is kept as a word only.
            ids = self._ids(word) if pieces == [word] else b"".join(map(self._piece, pieces))
        words.put(word, ids)
        return ids

    def _part(self, part: str) -> bytes:
        if not self._split.is_sure(part):
            return b"".join(map(self._piece, self._split.pieces(part)))
        words = part.split() if self._split.keeps_case else part.lower().split()
        found = list(map(self._words.young.get, words))
        if None in found:
            found = [self._word(w) if ids is None else ids for w, ids in zip(words, found)]
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        return b"".join([self._special.get(part) or self._part(part) for part in self._split.parts(text)])


@lru_cache(maxsize=1)
def encoder(content: str, pattern: str) -> Encoder:
    """One per worker process and vocabulary."""
    return Encoder(content, pattern)


@dataclass
class WrittenFile(WriterCommitMessage):
    place: int
    name: str
    n_docs: int
    n_tokens: int
    first: tuple
    last: tuple


@dataclass
class FilePart(InputPartition):
    name: str
    start: int

    def __init__(self, name: str, start: int):
        self.name, self.start = name, start


def _order(doc: int | None) -> tuple:
    return (doc is not None, doc or 0)


def _open(system: pafs.FileSystem, path: str) -> tuple[TokenFile, pa.NativeFile]:
    file = system.open_input_file(path)
    return TokenFile(lambda offset, size: file.read_at(size, offset), file.size()), file


def _manifest(path: str) -> list[dict]:
    system, top = open_folder(path)
    with system.open_input_stream(f"{top}/{MANIFEST}", compression=None) as stream:
        return json.loads(stream.read())


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenFile:
        system, top = open_folder(self.path)
        place = TaskContext.get().partitionId()
        name = f"part-{place:06d}-{uuid.uuid4().hex}.tokens"
        system.create_dir(top, recursive=True)
        n_docs, ends = 0, []
        with system.open_output_stream(f"{top}/{name}", compression=None) as stream:
            writer = FileWriter(stream)
            for batch in iterator:
                for doc, ids in zip(batch.column("id").to_pylist(), batch.column("ids")):
                    if ends and _order(ends[1]) > _order(doc):
                        raise ValueError(_UNORDERED)
                    writer.add(doc, np.frombuffer(ids.as_buffer(), dtype="<u4"))
                    n_docs += 1
                    ends = [ends[0] if ends else doc, doc]
            writer.finish()
        return WrittenFile(place, name, n_docs, writer.n_tokens, *map(_order, ends or (None, None)))

    def commit(self, messages: list[WrittenFile]) -> None:
        system, top = open_folder(self.path)
        system.create_dir(top, recursive=True)
        files = sorted((m for m in messages if m is not None and m.n_docs), key=lambda m: m.place)
        if any(a.last > b.first for a, b in zip(files, files[1:])):
            raise ValueError(_UNORDERED)
        if not self.overwrite and system.get_file_info(f"{top}/{MANIFEST}").type != pafs.FileType.NotFound:
            raise ValueError("there is a corpus already: its documents come before or after these, so it cannot grow in place")
        listed, start = [], 0
        for m in files:
            listed.append({"name": m.name, "start": start, "n_docs": m.n_docs, "n_tokens": m.n_tokens})
            start += m.n_tokens
        fresh = f"{top}/{MANIFEST}-{uuid.uuid4().hex}"
        with system.open_output_stream(fresh, compression=None) as stream:
            stream.write(json.dumps(listed).encode())
        system.move(fresh, f"{top}/{MANIFEST}")

    def abort(self, messages: list[WrittenFile]) -> None:
        """Nothing refers to the files of a failed write."""


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[FilePart]:
        return [FilePart(f["name"], f["start"]) for f in _manifest(self.path)] or [FilePart("", 0)]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, top = open_folder(self.path)
        opened, file = _open(system, f"{top}/{partition.name}")
        with file:
            for docs, spans, ids in opened.documents():
                data, first = pa.py_buffer(ids.astype("<u4")), spans[0][0]
                ends = np.array([0, *(4 * (b - first) for _, b in spans)])
                starts = np.array([a for a, _ in spans], dtype=np.int64)
                kind = pa.binary() if ends[-1] < 1 << 31 else pa.large_binary()
                offsets = pa.py_buffer(ends.astype(np.int32 if kind == pa.binary() else np.int64))
                column = pa.Array.from_buffers(kind, len(docs), [None, offsets, data])
                counts = np.diff(ends) // 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(starts + partition.start), pa.array(counts), column],
                    schema=_DOCUMENTS if kind == pa.binary() else _DOCUMENTS.set(3, pa.field("ids", kind)),
                )


class TokenCodes(DataSource):
    """Rows ``(id, ids)`` in the order of ids are written, rows ``(doc_id, start, n_tokens, ids)`` are read."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return DOCUMENTS_DDL

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


def encoded(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID, pattern: str = WORD_PATTERN) -> DataFrame:
    """``(id, ids)`` in the order of ids; ``ids`` are unsigned 32-bit little-endian numbers, the end id last."""
    rows = text_rows(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), text_key(), "text")
    rows = rows.repartitionByRange("id", "text_key").sortWithinPartitions("id", "text_key").select("id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(read_file(vocabulary))
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(shared.value, pattern)
        for batch in sliced(batches, 256):
            ids = [coder.encode(text.decode()) + end for text in byte_values(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.binary())], schema=_ENCODED)

    return rows.mapInArrow(run, "id long, ids binary")


def write_tokens(docs: DataFrame, vocabulary: str, path: str, **options) -> None:
    """Write a corpus of token ids below a folder that all executors reach."""
    spark = docs.sparkSession
    spark.dataSource.register(TokenCodes)
    encoded(docs, vocabulary, **options).write.format(FORMAT).mode("append").save(qualified(spark, path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document of a corpus."""
    spark.dataSource.register(TokenCodes)
    return spark.read.format(FORMAT).load(qualified(spark, path))


class TokenCorpus:
    """Random access to a corpus: files are opened when an id of theirs is asked for."""

    def __init__(self, path: str):
        self._files = _manifest(path)
        self._starts = [f["start"] for f in self._files]
        self._system, self._top = open_folder(path)
        self._opened = lru_cache(maxsize=16)(lambda name: _open(self._system, f"{self._top}/{name}")[0])

    def __len__(self) -> int:
        return self._starts[-1] + self._files[-1]["n_tokens"] if self._files else 0

    def token(self, place: int) -> int:
        """The id at a place of the whole corpus."""
        if not 0 <= place < len(self):
            raise IndexError(place)
        file = bisect_right(self._starts, place) - 1
        return self._opened(self._files[file]["name"]).token(place - self._starts[file])

    def tokens(self, begin: int, end: int) -> array:
        """The ids from one place to another, across files."""
        out, end = array("I"), min(end, len(self))
        while begin < end:
            file = bisect_right(self._starts, begin) - 1
            stop = min(end, self._starts[file] + self._files[file]["n_tokens"])
            opened = self._opened(self._files[file]["name"])
            out.frombytes(opened.tokens(begin - self._starts[file], stop - self._starts[file]).astype("=u4").tobytes())
            begin = stop
        return out


def round_trip(docs: DataFrame, vocabulary: str, path: str, **options) -> DataFrame:
    """Write a corpus and read it back."""
    work_root(docs.sparkSession)
    write_tokens(docs, vocabulary, path, **options)
    return read_tokens(docs.sparkSession, path)
