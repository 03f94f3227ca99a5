"""Documents whose word-shingle sets are nearly equal, by PartEnum signatures (operator 10).

A document's set holds its distinct shingles of five words, A-Z made lower case. Two sets link if
their Jaccard similarity is 0.8 or more, that is, if they differ in at most (s + t) / 9 shingles, s and t
being their sizes. The domain of shingles is cut into partitions by hash; sets that differ in h shingles agree in all but h
partitions. Sets are handled per band of sizes, so that h is bounded there by some k:

* small k: the domain has k + 3 partitions and every subset of three of them gives a signature, the
  hash of the set's shingles in these partitions. Linked sets agree in one such subset.
* otherwise: the domain has more than k partitions, and each gives a signature. Linked sets agree in all but k of them,
  so each set needs to show only its first k + 1 in an order common to all sets: those of most shingles first.

Equal sets are one node. Signatures are made and met in packed blocks: a block first combines its own
equal signatures, so a signature that very many sets share meets others once per block. Every set has a sketch
that bounds from below in how many shingles two sets differ, and those that met a wider one. Groups of a few members give the pairs that the sketches leave; large ones
give those with one member, the hub, and then, slice by slice, those across the components that the hubs' links
have made: pairs inside a component are never looked at, and of the others only those that the sketches leave become rows.
Of every such pair that the wide sketches leave, too, the whole texts are compared.

Cases: null and empty texts and texts of blanks have no set and link with nothing; fewer than five
words are one shingle; rows without an id have no component. Repeated rows link like any equal sets.
Shingles are compared, and equal sets found, by two independent fingerprints modulo 2 ** 61 - 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.similarity import connected_components
from ..session import new_work_dir, work_root
from .common import Fingerprints, batch_of, byte_values, mixed, release_finished, sliced, text_key, text_rows

SHINGLE_WORDS = 5
SPREAD = 25 / 16  # a band's largest size over its smallest
ENUMERATED = 3  # up to this many differing shingles, subsets are enumerated
SMALL_GROUP = 6
SLICE = 1_024
BROADCAST_PAIRS = 200_000
BLOCK_ROWS = 300_000
BUCKET_BYTES = 16 << 20

_BLANKS = np.array([b in b" \t\n\x0b\x0c\r" for b in range(256)])


def shingle_sets(texts: list[bytes], words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """``(row, shingle)``: the distinct shingle fingerprints of every text, by row and fingerprint."""
    row, shingles, _ = _shingles(texts, words)
    return row, shingles


def _shingles(texts: list[bytes], words: int = SHINGLE_WORDS, second: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """The same with the fingerprints of a second base, if asked for: both together stand for a shingle with 122 bits."""
    # Words are separated by one space, so the fingerprint of a stretch stands for a sequence of words.
    texts = [b" ".join(t.lower().split()) for t in texts]
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(_BLANKS[data])
    starts = np.concatenate([[0], ends[:-1] + 1])
    closing = data[ends] == 10
    row = np.cumsum(closing) - closing
    real = ends > starts
    starts, ends, row = starts[real], ends[real], row[real]
    if not len(starts):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64) if second else None
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    count = np.diff(np.concatenate([first, [len(row)]]))
    last = np.repeat(first + count - 1, count)
    at = np.arange(len(row))
    keep = (at + words - 1 <= last) | (at == np.repeat(first, count))
    at = at[keep]
    starts, ends, row = starts[at], ends[np.minimum(at + words - 1, last[at])], row[at]
    shingles = Fingerprints(data).of(starts, ends)
    order = np.lexsort((shingles, row))
    row, shingles = row[order], shingles[order]
    fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (shingles[1:] != shingles[:-1])])
    others = Fingerprints(data, 1).of(starts[order][fresh], ends[order][fresh]) if second else None
    return row[fresh], shingles[fresh], others


def _set_name(row: np.ndarray, shingles: np.ndarray, rows: int) -> np.ndarray:
    """A name of every row's set from the fingerprints of its shingles; equal sets have equal names."""
    sums = np.zeros(rows, dtype=np.uint64)
    np.add.at(sums, row, mixed(shingles ^ np.uint64(0x243F6A8885A308D3)))
    return mixed(sums + np.uint64(0x243F6A8885A308D3)).view(np.int64)


class Bands:
    """Bands of set sizes; band b holds sizes from ``low[b]`` to ``high[b]``."""

    def __init__(self, most: int = 1 << 40):
        low, self.low, self.high = 1, [], []
        while low <= most:
            high = max(low, int(low * SPREAD) - 1)
            self.low.append(low)
            self.high.append(high)
            low = high + 1
        self.low, self.high = np.array(self.low), np.array(self.high)

    def of_sizes(self, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(which, band)``: every size with its own band, then with higher ones a partner may lie in."""
        own = np.searchsorted(self.high, sizes)
        which = np.flatnonzero(sizes > 0)
        step = 0
        while len(which):
            yield which, own[which] + step
            step += 1
            which = which[5 * sizes[which] >= 4 * self.low[own[which] + step]]


def signatures(row: np.ndarray, shingles: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """``(row, signature)`` of every set."""
    rows_out, values_out = [], []
    start = np.concatenate([[0], np.cumsum(sizes)])
    for which, band in bands.of_sizes(sizes):
        # What the set may differ in from a partner of this band; nothing at all is an equal set.
        k = (sizes[which] + bands.high[band]) // 9
        band_k = 2 * bands.high[band] // 9
        salt = mixed(band.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        few = (band_k <= ENUMERATED) & (k > 0)
        for i in np.flatnonzero(few).tolist():
            own = shingles[start[which[i]] : start[which[i] + 1]]
            parts = int(band_k[i]) + 3
            part_of = (mixed(own ^ salt[i]) >> np.uint64(32)) % np.uint64(parts)
            sums = np.zeros(parts, dtype=np.uint64)
            np.add.at(sums, part_of.astype(np.int64), mixed(own))
            for n, chosen in enumerate(combinations(range(parts), 3)):
                rows_out.append(which[i : i + 1])
                values_out.append(mixed(mixed(sums[list(chosen)] + np.arange(1, 4, dtype=np.uint64)).sum(keepdims=True) + salt[i] + np.uint64(n)))
        many = np.flatnonzero(band_k > ENUMERATED)
        if not len(many):
            continue
        chosen, k, salt = which[many], k[many], salt[many]
        parts = (band_k[many] + 1) * 115 // 100 + 2
        base = np.concatenate([[0], np.cumsum(parts)])
        length = sizes[chosen]
        take = np.repeat(start[chosen] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        own = shingles[take]
        cell = ((mixed(own ^ np.repeat(salt, length)) >> np.uint64(32)) % np.repeat(parts, length).astype(np.uint64)).astype(np.int64)
        cell += np.repeat(base[:-1], length)
        sums = np.zeros(base[-1], dtype=np.uint64)
        np.add.at(sums, cell, mixed(own))
        filled = np.minimum(np.bincount(cell, minlength=base[-1]), 31)
        of = np.repeat(np.arange(len(chosen)), parts)
        # The first k + 1 partitions, fullest first; all of the last fullness reached are taken.
        at_least = np.bincount(of * 32 + filled, minlength=32 * len(chosen)).reshape(-1, 32)[:, ::-1].cumsum(axis=1)[:, ::-1]
        lowest = (at_least >= (k + 1)[:, None]).sum(axis=1) - 1
        shown = filled >= lowest[of]
        number = (np.arange(base[-1]) - base[:-1][of]).astype(np.uint64)
        values = mixed(mixed(sums + number * np.uint64(0x9E3779B97F4A7C15)) ^ np.repeat(salt, parts))
        rows_out.append(chosen[of[shown]])
        values_out.append(values[shown])
    if not rows_out:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    # 48 bits are enough to meet: what meets by chance is told apart later.
    return np.concatenate(rows_out), np.concatenate(values_out) >> np.uint64(16)


SKETCH_WORDS, WIDE_WORDS = 8, 128
_SKETCH = [f"sketch{i}" for i in range(SKETCH_WORDS)]
_SET_ROWS = pa.schema([(c, pa.int64()) for c in ("id", "text_key", "n_shingles", "node", "name", *_SKETCH)])
_SET_DDL = ", ".join(f"{c} long" for c in _SET_ROWS.names)


def _sketches(row: np.ndarray, shingles: np.ndarray, rows: int, words: int = SKETCH_WORDS) -> np.ndarray:
    """Parities of each set's shingles over some cells: two sketches differ in no more bits than the sets in shingles."""
    bits = words * 64
    cell = (mixed(shingles ^ np.uint64(0xA4093822299F31D0)) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(row * bits + cell, minlength=rows * bits).reshape(rows, bits) & 1
    return np.packbits(odd.astype(bool), axis=1).view("<i8")


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 128):
        rows = batch.num_rows
        row, shingles, others = _shingles(byte_values(batch.column("text")), second=True)
        # Two names from fingerprints of different bases: what one of them confuses the other tells apart.
        names = np.bincount(row, minlength=rows), _set_name(row, shingles, rows), _set_name(row, others, rows)
        yield batch_of(_SET_ROWS, batch.column("id"), batch.column("text_key"), *names, *_sketches(row, shingles, rows).T)


# Entries of one block for one bucket, packed; or, in buckets below zero, entries that skip the meeting.
_PACKED = pa.schema([("bucket", pa.int32()), ("entries", pa.int32()), ("payload", pa.binary())])
_PACKED_DDL = "bucket int, entries int, payload binary"
_ENTRY = np.dtype([("signature", "<u8"), ("node", "<i8"), ("size", "<i4")])
_MEMBERS = pa.schema([("signature", pa.int64()), ("node", pa.int64()), ("size", pa.int32())])
_MEMBERS_DDL = "signature long, node long, size int"


def _in_order(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct entries by signature and node; where each signature begins and how many nodes it has."""
    entries = entries[np.lexsort((entries["size"], entries["node"], entries["signature"]))]
    turn = entries["signature"][1:] != entries["signature"][:-1]
    fresh = np.concatenate([[True], turn | (entries["node"][1:] != entries["node"][:-1])])
    entries = entries[fresh]
    first = np.flatnonzero(np.concatenate([[True], entries["signature"][1:] != entries["signature"][:-1]]))
    return entries, first, np.diff(np.concatenate([first, [len(entries)]]))


def _blocks(buckets: int):
    def flush(parts: list[np.ndarray], first_piece: int) -> tuple[pa.RecordBatch, int]:
        entries, first, count = _in_order(np.concatenate(parts))
        # One entry per signature goes on to meet other blocks. If the block has more of it, they skip the
        # meeting, and the one that goes is marked by a negative size: its group is not yet whole.
        several = count > 1
        extra = entries[np.repeat(several, count)].copy()
        entries = entries[first].copy()
        entries["size"][several] *= -1
        bucket = (entries["signature"] % np.uint64(buckets)).astype(np.int32)
        entries = entries[np.argsort(bucket, kind="stable")]
        pieces = np.split(entries, np.cumsum(np.bincount(bucket, minlength=buckets))[:-1])
        rows = [(i, len(piece), _pack(piece)) for i, piece in enumerate(pieces) if len(piece)]
        # What skips the meeting is dealt over all buckets below zero, by the number of its task and its piece.
        extras = [extra[at : at + 10_000] for at in range(0, len(extra), 10_000)]
        task = TaskContext.get()
        number = np.arange(first_piece, first_piece + len(extras), dtype=np.uint64) + np.uint64((task.partitionId() if task else 0) << 32)
        dealt = (mixed(number) % np.uint64(buckets)).astype(np.int64)
        rows += [(-1 - to, len(piece), piece.tobytes()) for to, piece in zip(dealt.tolist(), extras)]
        return batch_of(_PACKED, *zip(*rows)), first_piece + len(extras)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands()
        parts, held, seen, pieces = [], 0, set(), 0
        for batch in sliced(batches, 128):
            texts = byte_values(batch.column("text"))
            row, shingles = shingle_sets(texts)
            sizes, node = np.bincount(row, minlength=len(texts)), _set_name(row, shingles, len(texts))
            known = np.fromiter((n in seen for n in node.tolist()), dtype=bool, count=len(node))
            if len(seen) < 1_000_000:
                seen.update(node.tolist())
            sizes_left = np.where(known, 0, sizes)
            keep = sizes_left[row] > 0
            at, values = signatures(row[keep], shingles[keep], sizes_left, bands)
            entries = np.empty(len(at), dtype=_ENTRY)
            entries["signature"], entries["node"], entries["size"] = values, node[at], sizes[at]
            parts.append(entries)
            held += len(entries)
            if held >= BLOCK_ROWS:
                block, pieces = flush(parts, pieces)
                yield block
                parts, held = [], 0
        if held:
            yield flush(parts, pieces)[0]

    return run


def _pack(entries: np.ndarray) -> bytes:
    """Signatures in full, nodes by their place in a list of the block's nodes."""
    nodes, first, place = np.unique(entries["node"], return_index=True, return_inverse=True)
    kind = "<u2" if len(nodes) <= 1 << 16 else "<u4"
    return b"".join([np.int64(len(nodes)).tobytes(), nodes.tobytes(), entries["size"][first].tobytes(), (entries["signature"] >> np.uint64(16)).astype("<u4").tobytes(),
                     entries["signature"].astype("<u2").tobytes(), place.astype(kind).tobytes()])


def _unpack(data: bytes, count: int) -> np.ndarray:
    n = int(np.frombuffer(data, dtype="<i8", count=1)[0])
    nodes = np.frombuffer(data, dtype="<i8", count=n, offset=8)
    sizes = np.frombuffer(data, dtype="<i4", count=n, offset=8 + 8 * n)
    at = 8 + 12 * n
    entries = np.empty(count, dtype=_ENTRY)
    high = np.frombuffer(data, dtype="<u4", count=count, offset=at).astype(np.uint64)
    entries["signature"] = high << np.uint64(16) | np.frombuffer(data, dtype="<u2", count=count, offset=at + 4 * count)
    place = np.frombuffer(data, dtype="<u2" if n <= 1 << 16 else "<u4", count=count, offset=at + 6 * count)
    entries["node"], entries["size"] = nodes[place], sizes[place]
    return entries


def _meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """All entries of one bucket: the signatures that several nodes have, or may have.

    Of the signatures whose nodes are all here, one stays of those with the same nodes.
    """
    packed = [(p, n) for p, n in zip(table.column("payload").to_pylist(), table.column("entries").to_pylist())]
    if key[0].as_py() < 0:
        entries = np.concatenate([np.frombuffer(p, dtype=_ENTRY) for p, _ in packed])
    else:
        entries, first, count = _in_order(np.concatenate([_unpack(p, n) for p, n in packed]))
        marked = np.minimum.reduceat(entries["size"], first) < 0
        names = np.add.reduceat(mixed(entries["node"].view(np.uint64)), first) + count.astype(np.uint64)
        _, kept = np.unique(np.where(marked, mixed(np.arange(len(first), dtype=np.uint64)), names), return_index=True)
        stays = np.zeros(len(first), dtype=bool)
        stays[kept] = True
        entries = entries[np.repeat(marked | (stays & (count > 1)), count)].copy()
        entries["size"] = np.abs(entries["size"])
    return pa.table([pa.array(entries["signature"].view(np.int64)), pa.array(entries["node"]), pa.array(entries["size"])], schema=_MEMBERS)


_TEXTS = pa.schema([("node", pa.int64()), ("size", pa.int32()), ("wide", pa.binary()), ("text", pa.string())])


def _with_wide_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 64):
        row, shingles = shingle_sets(byte_values(batch.column("text")))
        sizes = np.bincount(row, minlength=batch.num_rows)
        wide = [x.tobytes() for x in _sketches(row, shingles, batch.num_rows, WIDE_WORDS)]
        columns = [batch.column("node"), pa.array(sizes, pa.int32()), pa.array(wide, pa.binary()), batch.column("text")]
        yield pa.RecordBatch.from_arrays(columns, schema=_TEXTS)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that wide sketches do not rule out."""
    for batch in batches:
        sizes = batch.column("src_size").to_numpy() + batch.column("dst_size").to_numpy()
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u8").reshape(-1, WIDE_WORDS) for c in ("src_wide", "dst_wide"))
        differing = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
        yield batch.select(["src", "dst"]).filter(pa.array(9 * differing <= sizes))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Comparison of the two whole sets of every pair, shingles by both of their fingerprints."""
    for batch in sliced(batches, 64):
        n = batch.num_rows
        row, shingles, others = _shingles(byte_values(batch.column("src_text")) + byte_values(batch.column("dst_text")), second=True)
        sizes = np.bincount(row, minlength=2 * n)
        # A shingle that both sets of a pair have comes twice among the pair's shingles.
        order = np.lexsort((shingles, row % n))
        pair, shingles, others = (row % n)[order], shingles[order], others[order]
        twice = (pair[1:] == pair[:-1]) & (shingles[1:] == shingles[:-1]) & (others[1:] == others[:-1])
        common = np.bincount(pair[1:][twice], minlength=n)
        linked = pa.array(5 * common >= 4 * (sizes[:n] + sizes[n:] - common))
        yield batch.select(["src", "dst"]).filter(linked)


_PAIRS = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def _across(chains: bool):
    """Pairs of two slices of a group, in different components, that sizes and sketches do not rule out; with
    ``chains`` only those that chain components not chained by others before."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _compare_slices(key, table, chains)

    return run


def _compare_slices(key: tuple[pa.Scalar, ...], table: pa.Table, chains: bool) -> pa.Table:
    root: dict[int, int] = {}

    def find(n: int) -> int:
        while (up := root.get(n, n)) != n:
            root[n] = root.get(up, up)
            n = up
        return n

    _, a, b = (k.as_py() for k in key)
    slice_of, node, size, component = (table.column(c).to_numpy() for c in ("slice", "node", "size", "component"))
    sketch = np.stack([table.column(c).to_numpy() for c in _SKETCH], axis=1).view(np.uint64)
    left, right = np.flatnonzero(slice_of == a), np.flatnonzero(slice_of == b)
    src, dst = [], []
    for start in range(0, len(left), 64):
        some = left[start : start + 64]
        differing = np.zeros((len(some), len(right)), dtype=np.int32)
        for word in range(SKETCH_WORDS):
            differing += np.bitwise_count(sketch[some, word][:, None] ^ sketch[right, word][None, :])
        sizes = size[some][:, None] + size[right][None, :]
        apart = component[some][:, None] != component[right][None, :]
        i, j = np.nonzero(apart & (9 * differing <= sizes) & (9 * np.abs(size[some][:, None] - size[right][None, :]) <= sizes))
        if chains:
            kept = []
            for at, (x, y) in enumerate(zip(component[some[i]].tolist(), component[right[j]].tolist())):
                x, y = find(x), find(y)
                if x != y:
                    root[x] = y
                    kept.append(at)
            i, j = i[np.array(kept, dtype=np.int64)], j[np.array(kept, dtype=np.int64)]
        src.append(np.minimum(node[some[i]], node[right[j]]))
        dst.append(np.maximum(node[some[i]], node[right[j]]))
    src, dst = (np.concatenate([np.empty(0, dtype=np.int64), *x]) for x in (src, dst))
    return pa.table([pa.array(src), pa.array(dst)], schema=_PAIRS)


def linked_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text_key, n_shingles, group, component_id)`` of every row: the size of its set, a name of its component, and
    the smallest id of it."""
    spark = docs.sparkSession
    work_root(spark)
    rows = text_rows(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), text_key(), "text")
    sets = rows.mapInArrow(_sets_of, _SET_DDL).checkpoint()
    usable = sets.where("n_shingles > 0 AND id IS NOT NULL")
    classes = usable.groupBy("node", "name", "n_shingles").agg(
        F.min(F.struct("id", "text_key")).alias("first"), *(F.first(c).alias(c) for c in _SKETCH)
    ).select("node", "name", F.col("first.id").alias("first"), F.col("first.text_key").alias("first_key"), *_SKETCH).checkpoint()

    total = usable.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * 6 // BUCKET_BYTES + 1)
    members = (
        rows.where(F.col("id").isNotNull()).select("text").mapInArrow(_blocks(buckets), _PACKED_DDL)
        .groupBy("bucket").applyInArrow(_meet, _MEMBERS_DDL)
        .distinct()
        .checkpoint()
    )
    # Signatures with the same nodes are one group; groups of one node are none.
    alike = members.groupBy("signature").agg(
        F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("a"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("b")
    )
    whole = alike.where("members > 1").groupBy("members", "a", "b").agg(F.min("signature").alias("signature"))
    groups = members.join(whole.select("signature", "members"), "signature").withColumnRenamed("signature", "group").checkpoint()
    sketched = classes.select("node", *_SKETCH)
    small = groups.where(F.col("members") <= SMALL_GROUP).join(sketched, "node")
    # Near copies share many signatures: large groups with the same lowest member are one.
    large = groups.where(F.col("members") > SMALL_GROUP)
    lowest = large.groupBy("group").agg(F.min("node").alias("lowest"))
    merged = large.join(lowest, "group").select(F.col("lowest").alias("group"), "node", "size").distinct()
    large = merged.join(merged.groupBy("group").agg(F.count("*").alias("members")), "group").join(sketched, "node").checkpoint()
    release_finished(spark)
    wanted = groups.select("node").distinct().join(classes, "node").select("node", "first", F.col("first_key").alias("text_key"))
    # Of equal rows one text is enough.
    copy = F.row_number().over(Window.partitionBy("id", "text_key").orderBy(F.lit(1)))
    found = rows.join(wanted.withColumnRenamed("first", "id"), ["id", "text_key"]).withColumn("copy", copy).where("copy = 1")
    path = new_work_dir(spark, "texts")
    found.select("node", "text").mapInArrow(_with_wide_sketch, "node long, size int, wide binary, text string").write.parquet(path)
    texts = spark.read.parquet(path)

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs of members of one group that sizes and sketches do not rule out."""
        left = left.select("group", *(F.col(c).alias(f"src_{c}") for c in ("node", "size", *_SKETCH)))
        right = right.select("group", *(F.col(c).alias(f"dst_{c}") for c in ("node", "size", *_SKETCH)))
        differing = sum((F.bit_count(F.col(f"src_{c}").bitwiseXOR(F.col(f"dst_{c}"))) for c in _SKETCH), F.lit(0))
        sizes = F.col("src_size") + F.col("dst_size")
        fit = (9 * differing <= sizes) & (9 * F.abs(F.col("src_size") - F.col("dst_size")) <= sizes)
        return (
            left.join(right, "group").where((F.col("src_node") < F.col("dst_node")) & fit)
            .select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"))
        )

    def hubs(groups: DataFrame) -> DataFrame:
        """The lowest member of every group."""
        lowest = groups.groupBy("group").agg(F.min(F.struct("node", "size", *_SKETCH)).alias("hub"))
        return lowest.select("group", *(f"hub.{c}" for c in ("node", "size", *_SKETCH)))

    def with_both(pairs: DataFrame, *columns: str) -> DataFrame:
        """Pairs with columns of both their texts."""
        src, dst = (texts.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns)) for side in ("src", "dst"))
        if pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS:
            # Only what belongs to pairs moves.
            few = F.broadcast(pairs)
            both = src.join(few, "src").join(dst.join(few, "dst"), ["src", "dst"])
        else:
            both = pairs.join(src, "src").join(dst, "dst")
        return both.select("src", "dst", *(f"{side}_{c}" for side in ("src", "dst") for c in columns))

    def verified(pairs: DataFrame) -> DataFrame:
        likely = with_both(pairs.distinct().checkpoint(), "size", "wide").mapInArrow(_likely, "src long, dst long").checkpoint()
        linked = with_both(likely, "text").mapInArrow(_verify, "src long, dst long").checkpoint()
        release_finished(spark)
        return linked

    links = verified(joined(small, small).unionByName(joined(hubs(large), large)))
    components = connected_components(links).checkpoint()
    release_finished(spark)

    # Members of large groups that hubs have not brought together: all pairs across components, in slices.
    # First as many as it takes to chain those that may be linked, then what has not come together.
    slices = F.ceil(F.col("members") / SLICE).cast("int")
    both = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda s: F.struct(F.least("slice", s).alias("a"), F.greatest("slice", s).alias("b")))
    for chains in (True, False):
        placed = large.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
        split = placed.groupBy("group").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("group")
        sliced_members = placed.join(split, "group", "left_semi").withColumn("slices", slices).withColumn(
            "slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")
        )
        across = (
            sliced_members.withColumn("pair", F.explode(both))
            .select("group", "pair.a", "pair.b", "slice", "node", "size", "component", *_SKETCH)
            .groupBy("group", "a", "b").applyInArrow(_across(chains), "src long, dst long")
        )
        found = verified(across)
        if not found.isEmpty():
            links = links.unionByName(found)
            components = connected_components(links).checkpoint()
            release_finished(spark)

    named = (
        classes.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    )
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_node = named.join(smallest, "component").select("node", "name", F.col("component").alias("group"), "component_id")
    found = sets.join(of_node, ["node", "name"], "left")
    linked = F.col("id").isNotNull() & (F.col("n_shingles") > 0)
    return found.select(
        "id", "text_key", "n_shingles", F.when(linked, F.col("group")).alias("group"),
        F.when(linked, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, without those linked to a row of a smaller id; rows without a set stay."""
    linked = linked_documents(docs, id_col, text_col).where(F.col("group").isNotNull()).select("id", "text_key", "group")
    firsts = linked.groupBy("group").agg(F.min(F.struct("id", "text_key")).alias("first"))
    decided = (
        linked.join(firsts, "group")
        .groupBy(F.col("id").alias("_id"), F.col("text_key").alias("_text_key"))
        .agg(F.max(F.struct("id", "text_key") == F.col("first")).alias("_stays"))
    )
    key = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    own_id = F.col(f"`{id_col}`").cast("long")
    # Rows without an id or a set are in no group: they take no part in the join and the numbering.
    in_group = own_id.isNotNull() & F.coalesce(F.col(f"`{text_col}`"), F.lit("")).rlike("[^ \\t\\n\\x0b\\x0c\\r]")
    rows = docs.where(in_group).withColumn("_key", key).join(decided, (own_id == F.col("_id")) & (F.col("_key") == F.col("_text_key")), "left")
    # Equal rows are copies of each other: the first of them stays.
    copy = F.row_number().over(Window.partitionBy("_id", "_text_key").orderBy(F.lit(1)))
    rows = rows.withColumn("_copy", F.when(F.col("_id").isNull(), F.lit(1)).otherwise(copy))
    columns = [f"`{c}`" for c in docs.columns]
    kept = rows.where(F.col("_stays").isNull() | (F.col("_stays") & (F.col("_copy") == 1))).select(*columns)
    return kept.unionAll(docs.where(~in_group).select(*columns))
