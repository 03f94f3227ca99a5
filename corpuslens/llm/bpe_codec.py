"""Byte-pair encoding and decoding by forced boundaries (operator 6).

A pair of neighbouring bytes that no vocabulary token contains can never be joined: between them
there is a certain cut. Pre-tokens are cut at all such pairs; the fragments are encoded on their
own and their ids concatenated, which is the encoding of the whole, since every merge makes a
vocabulary token and so happens inside one fragment. Pre-tokens recur, so a worker
remembers the ids of those it has met, up to ``CACHE`` of them.

Cases: null and empty texts have no ids and decode to the empty text; repeated rows give repeated
results; special tokens inside a text are one id each, as the library has them by default. Ids
that decode to incomplete UTF-8 give replacement characters; ids outside the vocabulary are skipped.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, sliced, text_rows
from .pretokens import DIGITS, LETTERS, bytes_of, read_file, splitter

CACHE = 400_000
CACHED_LETTERS = 128
# The split pattern of the byte-level vocabulary: words and digits with the blank before them, short
# endings, anything else, blanks.
BYTE_PATTERN = rf" ?[{LETTERS}]+| ?[{DIGITS}]+|'(?:[stmd]|re|ve|ll)| ?[^\s{LETTERS}{DIGITS}]+|\s+(?!\S)|\s+"

ENCODED = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("ids", pa.list_(pa.int32()))])
ENCODED_DDL = "id long, n_bytes long, ids array<int>"
DECODED = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])
DECODED_DDL = "id long, ids array<int>, text string"


def id_arrays(column: pa.ListArray) -> list[np.ndarray]:
    """The rows of a column of id lists; null lists are empty."""
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    values = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends, ends[1:])]


class Codec:
    def __init__(self, content: str, pattern: str):
        self.split = splitter(content, pattern)
        vocabulary = self.split.tokenizer.get_vocab(with_added_tokens=False)
        self.token_bytes = {i: bytes_of(token) for token, i in vocabulary.items()}
        self.token_bytes |= {i: token.encode() for token, i in self.split.special.items()}
        self._joined = bytearray(1 << 16)
        for token in self.token_bytes.values():
            for left, right in zip(token, token[1:]):
                self._joined[left << 8 | right] = 1
        self._special = {token: np.int32(i).tobytes() for token, i in self.split.special.items()}
        self._known: dict[str, bytes] = {}

    def fragments(self, data: bytes) -> list[bytes]:
        """The bytes cut between every pair that no token contains."""
        joined, cut, out = self._joined, 0, []
        for at, (left, right) in enumerate(zip(data, data[1:]), 1):
            if not joined[left << 8 | right]:
                out.append(data[cut:at])
                cut = at
        out.append(data[cut:])
        return out

    def piece_ids(self, piece: str) -> bytes:
        """The ids of a pre-token, as 32-bit numbers in a row."""
        ids = [i for fragment in self.fragments(piece.encode()) for i in self.split.tokens(fragment)]
        packed = array("i", ids).tobytes()
        if len(piece) <= CACHED_LETTERS:
            if len(self._known) >= CACHE:
                self._known.clear()
            self._known[piece] = packed
        return packed

    def encode(self, text: str) -> np.ndarray:
        packed: list[bytes] = []
        for part in self.split.parts(text):
            if part in self._special:
                packed.append(self._special[part])
                continue
            pieces = self.split.pieces(part)
            found = list(map(self._known.get, pieces))
            if None in found:
                found = [self.piece_ids(p) if ids is None else ids for p, ids in zip(pieces, found)]
            packed += found
        return np.frombuffer(b"".join(packed), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        try:
            data = b"".join(map(self.token_bytes.__getitem__, ids.tolist()))
        except KeyError:
            data = b"".join([self.token_bytes.get(i, b"") for i in ids.tolist()])
        return data.decode("utf-8", errors="replace")


@lru_cache(maxsize=1)
def codec(content: str, pattern: str) -> Codec:
    """One per worker process and vocabulary."""
    return Codec(content, pattern)


def encode_batches(shared, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared.value, pattern)
        for batch in sliced(batches, 128):
            texts = byte_values(batch.column("text"))
            ids = [coder.encode(t.decode()) for t in texts]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, dtype=np.int32), *ids])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(t) for t in texts], pa.int64()), lists], schema=ENCODED)

    return run


def decode_batches(shared, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared.value, pattern)
        for batch in sliced(batches, 128):
            ids = batch.column("ids")
            texts = pa.array([coder.decode(x) for x in id_arrays(ids)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), ids, texts], schema=DECODED)

    return run


def _share(df: DataFrame, vocabulary: str):
    return df.sparkSession.sparkContext.broadcast(read_file(vocabulary))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = BYTE_PATTERN) -> DataFrame:
    """``(id, n_bytes, ids)`` of every row; ``vocabulary`` is the path of a tokenizers file."""
    rows = text_rows(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), "text")
    return rows.mapInArrow(encode_batches(_share(docs, vocabulary), pattern), ENCODED_DDL)


def decode(encoded: DataFrame, vocabulary: str, pattern: str = BYTE_PATTERN) -> DataFrame:
    """``(id, ids, text)`` of rows with ``id`` and ``ids``."""
    rows = encoded.select(F.col("id").cast("long").alias("id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(decode_batches(_share(encoded, vocabulary), pattern), DECODED_DDL)


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = BYTE_PATTERN, then=None, ddl: str = DECODED_DDL) -> DataFrame:
    """Encode and decode in one Python step; ``then`` makes batches of another schema from the decoded ones."""
    rows = text_rows(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), "text")
    shared = _share(docs, vocabulary)
    encoding, decoding = encode_batches(shared, pattern), decode_batches(shared, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = decoding(encoding(batches))
        return decoded if then is None else then(decoded)

    return rows.mapInArrow(run, ddl)
