"""Pairs of whole numbers that go through an exchange as compressed columns, and what tasks make of them.

A row of two longs takes some twelve bytes of a shuffle file. Sorted, as differences and in planes of bytes, many of them take half
of that and less. A task packs what it has read for each partition, and gets what lies in its own as two arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKED_ROWS = 1 << 21  # rows that a task packs together
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_PACKED = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("held", T.BinaryType()), T.StructField("frame", T.IntegerType())])


def whole(df: DataFrame, *columns: str) -> bool:
    """Whether columns are whole numbers, as packing needs them."""
    return all(isinstance(df.schema[c].dataType, WHOLE) for c in columns)


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers of 0 and more, as planes of bytes."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    held = pa.compress(planes.tobytes(), codec="zstd", asbytes=True)
    return b"".join((len(numbers).to_bytes(8, "little"), bytes([width]), len(held).to_bytes(8, "little"), held))


def _loosened(held: memoryview, at: int) -> tuple[np.ndarray, int]:
    many, width, size = int.from_bytes(held[at : at + 8], "little"), held[at + 8], int.from_bytes(held[at + 9 : at + 17], "little")
    planes = np.frombuffer(pa.decompress(held[at + 17 : at + 17 + size], many * width, "zstd", asbytes=True), np.uint8)
    numbers = np.zeros((many, 8), np.uint8)
    numbers[:, :width] = planes.reshape(width, many).T
    return numbers.view("<u8").ravel(), at + 17 + size


def pack(first: np.ndarray, second: np.ndarray) -> bytes:
    """Two columns of longs, without rows that come again, in order of the first."""
    first, second = unique_rows(first, second)
    names, places = np.unique(second, return_inverse=True)
    names, first = names.view(np.uint64), first.view(np.uint64)
    # The first of each goes as it is, the others as what they are above the one before.
    return b"".join(_squeezed(c) for c in (first[:1], np.diff(first), names[:1], np.diff(names), places.astype(np.uint64)))


def unpack(held: bytes) -> tuple[np.ndarray, np.ndarray]:
    held, columns, at = memoryview(held), [], 0
    while at < len(held):
        column, at = _loosened(held, at)
        columns.append(column)
    first, names = (np.cumsum(np.concatenate(c), dtype=np.uint64).view(np.int64) for c in (columns[:2], columns[2:4]))
    return first, names[columns[4].astype(np.int64)]


def unique_rows(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two columns once, in order."""
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    fresh = np.ones(len(first), bool)
    fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    return first[fresh], second[fresh]


def spread_number(numbers: np.ndarray) -> np.ndarray:
    """A number that differs in all bits for numbers that lie close."""
    mixed = numbers.astype(np.int64).view(np.uint64)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return mixed ^ (mixed >> np.uint64(33))


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[np.ndarray]]:
    """The columns of some batches together, so many rows at a time."""
    held, many = [], 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in batch.columns])
        many += batch.num_rows
        if many >= rows:
            yield [np.concatenate(c) for c in zip(*held)]
            held, many = [], 0
    if many:
        yield [np.concatenate(c) for c in zip(*held)]


def labels_of(spark: SparkSession, tasks: int) -> list[int]:
    """A number for each of some partitions that a hash of the number deals out to it."""
    found = spark.range(64 * tasks + 64).select(F.col("id").cast("int").alias("label")).groupBy(F.expr(f"pmod(hash(label), {tasks})")).agg(F.min("label")).collect()
    return [r[1] for r in found]


def tasks_of(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt_packed(first: str, second: str, *frames: DataFrame) -> DataFrame:
    """``(part, held, frame)``: rows of two columns of whole numbers, packed; those of equal ``first`` lie in one part, a part in
    one partition and its rows behind one another. ``frame`` is the place of the frame that had them. Rows with a null are left
    out, others can come once instead of several times."""
    spark = frames[0].sparkSession
    tasks = tasks_of(spark)
    labels = np.array(labels_of(spark, tasks), np.int32)

    def packed(df: DataFrame, frame: int) -> DataFrame:
        def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for one, two in gathered(batches, PACKED_ROWS):
                part = (spread_number(one) % np.uint64(len(labels))).astype(np.int64)
                order = np.argsort(part, kind="stable")
                ends = np.searchsorted(part[order], np.arange(len(labels) + 1))
                for p, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                    if a < b:
                        rows = order[a:b]
                        columns = [pa.array(labels[p : p + 1]), pa.array([pack(one[rows], two[rows])], pa.binary()), pa.array([frame], pa.int32())]
                        yield pa.RecordBatch.from_arrays(columns, names=_PACKED.names)

        rows = df.select(F.col(first).cast("long").alias("first"), F.col(second).cast("long").alias("second")).where("first IS NOT NULL AND second IS NOT NULL")
        return rows.mapInArrow(packs, _PACKED)

    every = reduce(DataFrame.unionByName, (packed(df, frame) for frame, df in enumerate(frames)))
    return every.repartition(tasks, "part").sortWithinPartitions("part")


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The two columns of each part of ``dealt_packed``, and the frames of the rows."""
    at, held = None, []
    for batch in batches:
        for part, blob, frame in zip(batch.column("part").to_pylist(), batch.column("held"), batch.column("frame").to_pylist()):
            if held and part != at:
                yield tuple(np.concatenate(c) for c in zip(*held))
                held = []
            at = part
            first, second = unpack(blob.as_buffer())
            held.append((first, second, np.full(len(first), frame, np.int8)))
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def forest(batches: Iterator[pa.RecordBatch], rows: int = PACKED_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of nodes to the lowest one they reach over the links of a task: as connected as all of these, a link per node at most."""
    high = low = np.empty(0, np.int64)
    for one, two in gathered(batches, rows):
        high, low = _reached(np.concatenate([high, one]), np.concatenate([low, two]))
    yield high, low


def _reached(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nodes, places = np.unique(np.concatenate([one, two]), return_inverse=True)
    one, two, lowest = places[: len(one)], places[len(one) :], np.arange(len(nodes))
    while True:
        a, b = lowest[one], lowest[two]
        differ = a != b
        if not differ.any():
            break
        one, two, a, b = one[differ], two[differ], a[differ], b[differ]
        np.minimum.at(lowest, np.maximum(a, b), np.minimum(a, b))
        while (further := lowest[lowest]).tobytes() != lowest.tobytes():
            lowest = further
    linked = lowest != np.arange(len(nodes))
    return nodes[linked], nodes[lowest[linked]]
