"""Small helpers shared by the operators of this subpackage.

Operators take the names of the id and text columns, copy these two out under names of their own,
and give back columns of their own: further columns of the input, whatever they are called, never
meet them. A null text counts as an empty one.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text)``: the two columns an operator reads, null texts made empty."""
    return docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )


def release_finished(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps that are done: Spark deletes them once the driver has
    collected the objects that stand for them, which it may not do by itself for a long time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_key() -> Column:
    """Tells texts of rows with the same id apart: rows of one id and one text have one result."""
    return F.xxhash64("text").alias("text_key")


def join_rows(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on (id, text_key), also where the id is null, and keep one copy of the two."""
    right = right.withColumnsRenamed({"id": "_id", "text_key": "_text_key"})
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_text_key"))
    return left.join(right, same, how).drop("_id", "_text_key")


def without_rows(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows, with all their columns, whose (id, text_key) is not among those found."""
    found = found.select(F.col("id").alias("_found_id"), F.col("text_key").alias("_found_key"))
    key = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("_found_id")) & (key == F.col("_found_key"))
    return docs.join(found, same, "left_anti")


def ascii_lower(value: Column) -> Column:
    """A-Z made lower case, everything else as it is."""
    ascii_only = F.octet_length(value) == F.length(value)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(ascii_only, F.lower(value)).otherwise(F.translate(value, upper, upper.lower()))


def byte_values(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column, without decoding them first."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches: what an operator makes of one batch stays small, whatever the batch size."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# Arithmetic modulo the prime 2 ** 61 - 1: a polynomial of a given degree has no more roots than that, so two different
# stretches of n bytes have one fingerprint for n of the 2 ** 61 bases at most, whatever they look like.
# (Modulo 2 ** 64 texts by the Thue-Morse rule collide under every odd base.)
PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)
_BASES = (0x0B2D4D1A7F3C5E91, 0x17A6E5C93D08F24B)  # two bases, drawn once: their fingerprints are independent of each other
_SEGMENT = 1 << 16  # bytes handled at once, so that the arrays in between stay in the cache


def _u(value: int) -> np.uint64:
    return np.uint64(value)


def _reduced(x: np.ndarray) -> np.ndarray:
    """Below the prime, for any number of 64 bits."""
    x = (x & _P) + (x >> _u(61))
    return x - _P * (x >= _P)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, by halves of 30 and 31 bits."""
    a_high, a_low = a >> _u(31), a & _u((1 << 31) - 1)
    b_high, b_low = b >> _u(31), b & _u((1 << 31) - 1)
    middle = a_low * b_high + a_high * b_low
    # 2 ** 61 counts as one: 2 ** 62 of the high halves as two, and what the middle has above bit 30 as itself.
    return _reduced((a_high * b_high << _u(1)) + (middle >> _u(30)) + ((middle & _u((1 << 30) - 1)) << _u(31)) + a_low * b_low)


class _Powers:
    """Powers of a base and of its inverse, as many as were asked for; the former split at bit 30."""

    def __init__(self, base: int):
        self._base, self._inverse = base, pow(base, -1, PRIME)
        self.low, self.high, self.inverse = (np.empty(0, dtype=np.uint64) for _ in range(3))

    @staticmethod
    def _first(base: int, count: int) -> np.ndarray:
        out, known = np.ones(count, dtype=np.uint64), 1
        while known < count:
            more = min(known, count - known)
            out[known : known + more] = _times(out[:more], _u(pow(base, known, PRIME)))
            known += more
        return out

    def upto(self, count: int) -> _Powers:
        if len(self.inverse) < count:
            count = 1 << max(16, (count - 1).bit_length())
            powers = self._first(self._base, count)
            self.low, self.high = powers & _u((1 << 30) - 1), powers >> _u(30)
            self.inverse = self._first(self._inverse, count)
        return self


_POWERS = [_Powers(base % PRIME) for base in _BASES]


class Fingerprints:
    """Fingerprints of stretches of one byte buffer; equal bytes have equal ones wherever they lie. ``which`` names the base."""

    def __init__(self, data: np.ndarray, which: int = 0):
        powers = _POWERS[which].upto(len(data) + 1)
        self._sums, self._inverse = np.empty(len(data) + 1, dtype=np.uint64), powers.inverse
        self._sums[0] = carry = _u(0)
        for at in range(0, len(data), _SEGMENT):
            byte = data[at : at + _SEGMENT].astype(np.uint64) + _u(1)
            # Sums of 39 and 40 bits each: no overflow within a segment.
            low = np.cumsum(byte * powers.low[at : at + len(byte)])
            high = np.cumsum(byte * powers.high[at : at + len(byte)])
            sums = _reduced((high >> _u(31)) + ((high & _u((1 << 31) - 1)) << _u(30)) + low + carry)
            self._sums[at + 1 : at + 1 + len(byte)] = sums
            carry = sums[-1]

    def _from(self, begin: np.ndarray, end: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        difference = end + _P - begin
        return mixed(_times(difference - _P * (difference >= _P), inverse))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self._from(self._sums[starts], self._sums[ends], self._inverse[starts])

    def grams(self, length: int) -> np.ndarray:
        """Of the stretch of the given length at every offset at which it fits."""
        out = np.empty(max(len(self._sums) - length, 0), dtype=np.uint64)
        for at in range(0, len(out), _SEGMENT):
            stop = min(at + _SEGMENT, len(out))
            out[at:stop] = self._from(self._sums[at:stop], self._sums[at + length : stop + length], self._inverse[at:stop])
        return out
