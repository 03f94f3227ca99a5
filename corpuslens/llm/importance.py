"""Importance resampling of documents towards a target text (operator 11).

Features are words and pairs of neighbouring words; each falls into the bucket of its CRC-32 modulo
``BUCKETS``. The counts of the buckets over all documents and over the target text give every bucket
a gain, a document's weight is the mean gain of its features, and the documents with the largest
weight plus Gumbel noise are drawn: sampling without replacement in proportion to importance.

A CRC is linear over exclusive or. What one byte adds to it depends on the byte and on its distance from
the end of its feature only, so a table of (distance, byte) holds all such contributions,
``bitwise_xor.reduceat`` over the spans of the features adds them up for all features of a batch at once, and
a constant per length puts in the start value and the final complement. Features longer than the
table fold block by block: a CRC moves on by a whole block as its own four bytes would.

Counts go through one combined array per task, at most ``BUCKETS`` rows. The driver holds the gains of the
buckets, nothing that grows with the documents. Ranks come from range partitions and partition offsets.

Cases: null and empty texts have no features, weight 0 and no rank; repeated rows count each and
are ranked each; a null id is hashed as the empty text; an empty target makes every
gain that of no target counts; equal scores rank by id, then by text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..session import work_root
from .common import batch_of, byte_values, text_key, text_rows, without_rows

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
SCALE = 1_000  # gains and noise are whole thousandths

TABLE_BYTES = 64  # distances in the table; longer features fold in blocks of so many bytes
PIECE_BYTES = 1 << 18  # bytes of words handled at once, and
STEP_BYTES = 1 << 20  # bytes of spans: both bound the arrays whatever a text's length

_POLYNOMIAL = 0xEDB88320
_OUTSIDE = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]


@lru_cache(maxsize=1)
def _contributions() -> np.ndarray:
    """At ``distance * 256 + byte``: what the byte adds to a CRC register that started at zero."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(_POLYNOMIAL), step >> 1).astype(np.uint32)
    rows = [step]
    for _ in range(TABLE_BYTES - 1):
        rows.append((rows[-1] >> np.uint32(8)) ^ step[rows[-1] & np.uint32(0xFF)])
    return np.concatenate(rows)


@lru_cache(maxsize=64)
def _mover(doubling: int) -> np.ndarray:
    """At ``place * 256 + byte``: what a byte of a register becomes ``2 ** doubling`` blocks later."""
    if doubling == 0:
        rows = _contributions().reshape(TABLE_BYTES, 256)
        return np.concatenate([rows[TABLE_BYTES - 1 - place] for place in range(4)])
    return _moved(_mover(doubling - 1), doubling - 1)


def _moved(registers: np.ndarray, doubling: int) -> np.ndarray:
    """Registers after ``2 ** doubling`` blocks of zero bytes."""
    table, out = _mover(doubling), np.zeros_like(registers)
    for place in range(4):
        byte = (registers >> np.uint32(8 * place)) & np.uint32(0xFF)
        out ^= table[byte.astype(np.int64) + place * 256]
    return out


@lru_cache(maxsize=1)
def _length_constants() -> np.ndarray:
    """CRCs of so many zero bytes: the part of a CRC that the length alone decides."""
    return np.array([zlib.crc32(bytes(n)) for n in range(TABLE_BYTES + 1)], dtype=np.uint32)


def _sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The contributions of spans of 1 to ``TABLE_BYTES`` bytes, added up within each span."""
    out, table = np.empty(len(starts), dtype=np.uint32), _contributions()
    lengths = ends - starts
    rows = STEP_BYTES // TABLE_BYTES
    for at in range(0, len(starts), rows):
        some = lengths[at : at + rows]
        stops = np.cumsum(some)
        place = np.arange(int(stops[-1]), dtype=np.int32)
        distance = np.repeat((stops - 1).astype(np.int32), some) - place
        byte = data[place + np.repeat(ends[at : at + rows] - stops, some)]
        out[at : at + rows] = np.bitwise_xor.reduceat(table[(distance << 8) + byte], stops - some)
    return out


def _folded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Spans longer than the table: the sums of their blocks, each moved over the blocks behind it."""
    lengths = ends - starts
    blocks = -(-lengths // TABLE_BYTES)
    last = np.cumsum(blocks)
    span = np.repeat(np.arange(len(starts)), blocks)
    behind = np.repeat(last - 1, blocks) - np.arange(len(span))
    stop = ends[span] - behind * TABLE_BYTES
    registers = _sums(data, np.maximum(stop - TABLE_BYTES, starts[span]), stop)
    for doubling in range(int(behind.max()).bit_length()):
        far = np.flatnonzero(behind >> doubling & 1)
        registers[far] = _moved(registers[far], doubling)
    different, which = np.unique(lengths, return_inverse=True)
    constants = np.array([zlib.crc32(bytes(int(n))) for n in different], dtype=np.uint32)
    return np.bitwise_xor.reduceat(registers, last - blocks) ^ constants[which]


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of every span of a byte array, as unsigned 32-bit numbers."""
    lengths = ends - starts
    out = np.zeros(len(starts), dtype=np.uint32)
    short = np.flatnonzero((lengths > 0) & (lengths <= TABLE_BYTES))
    if len(short):
        out[short] = _sums(data, starts[short], ends[short]) ^ _length_constants()[lengths[short]]
    long = np.flatnonzero(lengths > TABLE_BYTES)
    if len(long):
        out[long] = _folded(data, starts[long], ends[long])
    return out


@lru_cache(maxsize=1)
def _word_bytes() -> bytes:
    """Lower-cases A-Z and makes a blank of every byte that no word contains."""
    table = bytearray(range(256))
    for byte in _OUTSIDE:
        table[byte] = 0x20
    table[ord("A") : ord("Z") + 1] = bytes(range(ord("a"), ord("z") + 1))
    return bytes(table)


def _pieces(text: bytes) -> Iterator[tuple[bytes, bool]]:
    """A text's words, one blank between them, in pieces; whether a piece begins with the last word of the one before."""
    text, at, last = text.translate(_word_bytes()), 0, b""
    while at < len(text):
        stop = text.find(b" ", at + PIECE_BYTES) if len(text) - at > PIECE_BYTES else -1
        stop = len(text) if stop < 0 else stop
        words = text[at:stop].split()
        if words:
            yield b" ".join([last, *words] if last else words), bool(last)
            last = words[-1]
        at = stop


def _features_of(held: list[tuple[int, bytes, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join([piece for _, piece, _ in held]), dtype=np.uint8)
    breaks = np.flatnonzero((data == 0x20) | (data == 0x0A))
    starts, ends = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(data)]])
    neighbours = data[breaks] == 0x20
    first = np.concatenate([[True], ~neighbours])
    piece = np.cumsum(first) - 1
    owner = np.array([doc for doc, _, _ in held])[piece]
    single = np.flatnonzero(~(first & np.array([again for _, _, again in held])[piece]))
    pair = np.flatnonzero(neighbours)
    crcs = span_crcs(data, np.concatenate([starts[single], starts[pair]]), np.concatenate([ends[single], ends[pair + 1]]))
    return np.concatenate([owner[single], owner[pair]]), crcs, owner[single]


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Some features at a time: the text each is of, its CRC, and the texts that their words are of."""
    held: list[tuple[int, bytes, bool]] = []
    size = 0
    for doc, text in enumerate(texts):
        for piece, again in _pieces(text):
            held.append((doc, piece, again))
            size += len(piece)
            if size >= PIECE_BYTES:
                yield _features_of(held)
                held, size = [], 0
    if held:
        yield _features_of(held)


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of a table fall into each bucket. Each task adds up its own before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, crcs, _ in features(byte_values(batch.column("text"))):
                total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "n": pa.array(total[some], pa.int64())})

    texts = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    counts = np.zeros(buckets, dtype=np.int64)
    for row in texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row.bucket] = row.n
    return counts


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Whole thousandths of the log ratio of a bucket's share in the target to its share in all documents."""
    have, want = bucket_counts(docs, text_col, buckets).tolist(), bucket_counts(target, target_text_col, buckets).tolist()
    n_have, n_want = sum(have) + buckets, sum(want) + buckets
    return np.array(
        [math.floor(SCALE * math.log((t + 1) * n_have / ((s + 1) * n_want))) for s, t in zip(have, want)], dtype=np.int64
    )


def _noise(seed: int, doc: int | None) -> int:
    """Gumbel noise that the seed and the id alone decide."""
    key = f"{seed}:{'' if doc is None else doc}"
    h = int(sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = pa.schema(
    [("id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64())]
)
_SCORED_DDL = "id long, text_key long, n_words long, n_features long, weight long, score long"


def score_documents(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """``(id, text_key, n_words, n_features, weight, score)`` of every row."""
    rows = text_rows(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), text_key(), "text")
    shared = docs.sparkSession.sparkContext.broadcast(np.asarray(gains, dtype=np.int64))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = shared.value
        for batch in batches:
            rows = batch.num_rows
            n_words, n_features, total = (np.zeros(rows, dtype=np.int64) for _ in range(3))
            for owner, crcs, words in features(byte_values(batch.column("text"))):
                n_words += np.bincount(words, minlength=rows)
                n_features += np.bincount(owner, minlength=rows)
                # Sums of whole numbers below 2 ** 53: exact in doubles.
                total += np.bincount(owner, weights=gains[crcs % np.uint32(len(gains))], minlength=rows).astype(np.int64)
            weight = np.floor_divide(total, np.maximum(n_features, 1))
            noise = np.array([_noise(seed, doc) for doc in batch.column("id").to_pylist()], dtype=np.int64)
            yield batch_of(_SCORED, batch.column("id"), batch.column("text_key"), n_words, n_features, weight, weight + noise)

    return rows.mapInArrow(score, _SCORED_DDL)


def ranked(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Scored rows with ``rank`` from 1 for the ``percent`` highest scores among texts of ``min_words`` words, else null."""
    short = scored.select("*", (F.col("n_words") < min_words).alias("short"), (-F.col("score")).alias("_low"))
    rows = numbered(short, ["short", "_low", "id", "text_key"], "_row_no")
    drawn = percent * rows.where(~F.col("short")).count() // 100
    return rows.withColumn("rank", F.when(F.col("_row_no") < drawn, F.col("_row_no") + 1)).drop("_row_no", "_low", "short")


def importance_ranks(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
    buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
) -> DataFrame:
    """``(id, text_key, n_words, n_features, weight, score, rank)`` of every row; a null rank is not drawn."""
    work_root(docs.sparkSession)
    gains = bucket_gains(docs, target, text_col, target_text_col, buckets)
    return ranked(score_documents(docs, gains, id_col, text_col, seed), percent, min_words)


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows drawn, with all their columns. Rows of one id and one text go or stay together."""
    ranks = importance_ranks(docs, target, id_col, text_col, **options).where("rank IS NULL")
    return without_rows(docs, ranks, id_col, text_col)
