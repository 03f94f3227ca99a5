"""Lines that many documents share, kept in one document only (operator 9).

Every text gives one row per distinct long line key: a 128-bit hash, the document, the places of
the lines. The rows are range-partitioned by (hash, document) and sorted by document and position,
and each partition is streamed: the first document of a run of one hash is the one that keeps its
lines. A very frequent key spans several partitions, because documents are part of the range; runs
cut by a border are settled by one small aggregate over the border rows. What comes back are keep
bitmaps per document, compressed, never texts; ``kept_text`` applies them.

Cases: a null or empty text is one empty line. A document is an id; a null id counts as one more
document, smaller than any other. Rows with the same id are one document for counting, and each
of its rows keeps or loses its own lines. Rows with the same id and text have the same result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import work_root
from .common import batch_of, byte_values, join_rows, text_key, text_rows

MIN_CHARS = 40
MIN_DOCS = 5

_KEY_ROWS = pa.schema(
    [("hash", pa.binary()), ("id", pa.int64()), ("text_key", pa.int64()), ("n_lines", pa.int32()),
     ("places", pa.list_(pa.int32()))]
)
_KEY_DDL = "hash binary, id long, text_key long, n_lines int, places array<int>"
# How a streamed row leaves its partition.
DROPPED, UNSETTLED, SETTLED_RUN = 0, 1, 2


_CONTINUATION = bytes(range(0x80, 0xC0))  # bytes that continue a code point; without them, length counts code points


def _line_keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            ids, keys = batch.column("id").to_pylist(), batch.column("text_key").to_pylist()
            for doc, key, text in zip(ids, keys, byte_values(batch.column("text"))):
                lines = text.split(b"\n")
                found: dict[bytes, list[int]] = {}
                for place, line in enumerate(lines):
                    if len(line) < min_chars:
                        continue
                    # bytes.strip and bytes.lower know ASCII only: exactly the blanks and letters meant.
                    line = line.strip().lower()
                    if len(line.translate(None, _CONTINUATION)) >= min_chars:
                        found.setdefault(blake2b(line, digest_size=16).digest(), []).append(place)
                for value, places in found.items():
                    for column, item in zip(out, (value, doc, key, len(lines), places)):
                        column.append(item)
            yield batch_of(_KEY_ROWS, *out)

    return run


def _stream_runs(min_docs: int):
    """Walk a sorted partition; a run is the rows of one hash, its first document the one that keeps."""
    schema = pa.schema([*_KEY_ROWS, pa.field("state", pa.int8())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, first_run = None, True
        docs_seen, last_doc, keeper = 0, None, None
        held: list[tuple] = []  # rows of the first few documents of the run

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                value, doc = row[0], row[1]
                if value != current:
                    # The run before has ended inside this partition: short ones keep all lines.
                    if current is not None:
                        first_run = False
                    current, docs_seen, last_doc, keeper, held = value, 1, doc, doc, []
                elif doc != last_doc:
                    docs_seen, last_doc = docs_seen + 1, doc
                if first_run:
                    out.append((*row, UNSETTLED))
                elif docs_seen < min_docs:
                    held.append(row)
                else:
                    out.extend((*r, DROPPED) for r in held if r[1] != keeper)
                    held = []
                    if doc != keeper:
                        out.append((*row, DROPPED))
            yield batch_of(schema, *(zip(*out) if out else [[]] * len(schema)))
        out = [(*r, UNSETTLED) for r in held]
        if current is not None and not first_run and not held:
            out.append((current, keeper, 0, 0, [], SETTLED_RUN))
        yield batch_of(schema, *(zip(*out) if out else [[]] * len(schema)))

    return run


@F.pandas_udf(T.BinaryType())
def _bitmap(places: pd.Series, n_lines: pd.Series) -> pd.Series:
    def one(dropped, count):
        keep = np.ones(count, dtype=bool)
        keep[np.asarray(dropped, dtype=np.int64)] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return pd.Series([one(p, n) for p, n in zip(places, n_lines)], dtype=object)


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """``(id, text_key, n_lines, n_dropped, keep)`` of the documents that lose lines.

    ``keep`` is a zlib-compressed bitmap with one bit per line. A key of ``min_chars`` code points
    or more that ``min_docs`` documents or more hold loses its lines in all but the largest of them.
    """
    work_root(docs.sparkSession)
    rows = text_rows(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), text_key(), "text")
    keys = rows.mapInArrow(_line_keys(min_chars), _KEY_DDL)
    order = (F.col("hash"), F.desc_nulls_last("id"), F.col("text_key"))
    ranged = keys.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    streamed = ranged.mapInArrow(_stream_runs(min_docs), f"{_KEY_DDL}, state byte").checkpoint()

    border = streamed.where(F.col("state") != DROPPED)
    runs = (
        border.groupBy("hash", "id").agg(F.max("state").alias("state"))
        .groupBy("hash")
        .agg(F.max("id").alias("keeper"), F.count("*").alias("n_docs"), F.max("state").alias("state"))
        .where((F.col("n_docs") >= min_docs) | (F.col("state") == SETTLED_RUN))
        .select("hash", "keeper")
    )
    settled = (
        border.where(F.col("state") == UNSETTLED)
        .join(runs, "hash")
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
    )
    columns = ["id", "text_key", "n_lines", "places"]
    dropped = streamed.where(F.col("state") == DROPPED).select(*columns).unionByName(settled.select(*columns))
    # Equal rows of the input give equal places; as a set they count once.
    return (
        dropped.groupBy("id", "text_key")
        .agg(F.max("n_lines").alias("n_lines"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
        .select("id", "text_key", "n_lines", F.size("places").alias("n_dropped"), _bitmap("places", "n_lines").alias("keep"))
    )


@F.pandas_udf(T.StringType())
def _apply(text: pd.Series, keep: pd.Series) -> pd.Series:
    def one(value, bitmap):
        if bitmap is None:
            return value
        lines = value.split("\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=len(lines))
        return "\n".join([line for line, bit in zip(lines, bits) if bit])

    return pd.Series([one(t, k) for t, k in zip(text, keep)], dtype=object)


def kept_text(text: Column, keep: Column) -> Column:
    """A text without the lines its bitmap leaves out; without a bitmap it stays as it is."""
    return F.when(keep.isNull(), text).otherwise(_apply(F.when(keep.isNotNull(), text), keep))


def deduplicate_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """``(id, text, n_lines, n_dropped)`` for every row, texts without the lines they lose."""
    bitmaps = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    rows = text_rows(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), text_key(), "text")
    joined = join_rows(rows, bitmaps.drop("n_lines"), "left").select(
        "id", "text", "keep", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped")
    )
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    return joined.select(
        "id", kept_text(F.col("text"), F.col("keep")).alias("text"), (breaks + 1).cast("long").alias("n_lines"), "n_dropped"
    )


def without_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows with all their columns, texts without the lines they lose; null texts become empty."""
    bitmaps = keep_bitmaps(docs, id_col, text_col, **options).select(
        F.col("id").alias("_id"), F.col("text_key").alias("_text_key"), F.col("keep").alias("_keep")
    )
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_text_key"))
    return docs.join(bitmaps, same, "left").withColumn(text_col, kept_text(text, F.col("_keep"))).select(*[f"`{c}`" for c in docs.columns])
