"""Directly addressable codes of token ids, and the files that hold them (operator 13).

The bits of an id are split into chunks, lowest first, one level each. A level holds the chunks of
all ids that reach it, packed one after the other, and a bitmap that says which of them continue on the next level. The place
of a chunk on the next level is the number of continuations before it: a rank directory has that
number for every 512th place, so any id is read from a few bytes per level and nothing else is decoded.
Frequent ids are small in a BPE vocabulary and end on the first level. How many bits each level takes is
chosen for the ids at hand, by the smallest sum over all ways to split.

A file is a row of segments of at most ``SEGMENT`` ids, so that a writer holds one segment whatever a document's
length, and a footer with the places of segments and documents.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np

SEGMENT = 1 << 20
RANK_PLACES = 512
_BLOCK = 1 << 16  # ids packed or unpacked at once; a multiple of 8
_MAGIC = b"TOKCODE1"
_TRAILER = 16

Read = Callable[[int, int], bytes]


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """How many bits each id takes; zero takes one."""
    return np.maximum(np.frexp(ids.astype(np.float64))[1], 1)


def level_widths(ids: np.ndarray) -> list[int]:
    """Bits per level for the smallest codes: chunks, bitmaps and rank directories added up."""
    if not len(ids):
        return [1]
    counts = np.bincount(bit_lengths(ids))
    most = len(counts) - 1
    # longer[k]: how many ids have bits beyond the first k, and so a chunk that begins there.
    longer = [len(ids), *(len(ids) - np.cumsum(counts)[1:]).tolist()]
    best: list[tuple[float, int]] = [(0.0, 0)] * (most + 1)
    for begin in range(most - 1, -1, -1):
        best[begin] = min(
            (longer[begin] * (width + (1 + 32 / RANK_PLACES if begin + width < most else 0)) + best[begin + width][0], width)
            for width in range(1, most - begin + 1)
        )
    widths, begin = [], 0
    while begin < most:
        widths.append(best[begin][1])
        begin += widths[-1]
    return widths


def _holder(width: int) -> tuple[str, int]:
    """The smallest type that holds numbers of so many bits, highest byte first, and its bits."""
    return next((kind, size) for kind, size in ((">u1", 8), (">u2", 16), (">u4", 32)) if width <= size)


def pack(chunks: np.ndarray, width: int) -> bytes:
    """Numbers below ``2 ** width``, one after the other without gaps."""
    out, (kind, size) = [], _holder(width)
    for at in range(0, len(chunks), _BLOCK):
        octets = chunks[at : at + _BLOCK].astype(kind).view(np.uint8).reshape(-1, size // 8)
        out.append(np.packbits(np.unpackbits(octets, axis=1)[:, size - width :]).tobytes())
    return b"".join(out)


def unpack(read: Read, offset: int, width: int, begin: int, end: int) -> np.ndarray:
    """Numbers ``begin`` to ``end`` of those packed at an offset."""
    out = np.empty(end - begin, dtype=np.uint32)
    octets = (width + 14) // 8  # that a number can lie in, wherever it begins
    for at in range(begin, end, _BLOCK):
        stop = min(at + _BLOCK, end)
        first, last = at * width // 8, -(-stop * width // 8)
        data = np.frombuffer(read(offset + first, last - first) + bytes(octets), dtype=np.uint8)
        if width == 1:
            out[at - begin : stop - begin] = np.unpackbits(data, count=stop - first * 8)[at - first * 8 :]
            continue
        bit = np.arange(at * width - first * 8, stop * width - first * 8, width)
        byte, window = bit >> 3, np.zeros(stop - at, dtype=np.uint64)
        for further in range(octets):
            window = window << np.uint64(8) | data[byte + further]
        window >>= (8 * octets - width - (bit & 7)).astype(np.uint64)
        out[at - begin : stop - begin] = window & np.uint64((1 << width) - 1)
    return out


def encode_levels(ids: np.ndarray) -> tuple[list[list[int]], bytes]:
    """``([width, count] per level, their bytes)`` of unsigned 32-bit ids."""
    widths, rest = level_widths(ids), ids.astype(np.uint32)
    levels, out = [], []
    for number, width in enumerate(widths):
        levels.append([width, len(rest)])
        out.append(pack(rest & np.uint32((1 << width) - 1), width))
        if number + 1 < len(widths):
            rest = rest >> np.uint32(width)
            goes_on = rest > 0
            out.append(np.packbits(goes_on).tobytes())
            counts = np.add.reduceat(goes_on, np.arange(0, len(goes_on), RANK_PLACES), dtype=np.uint32)
            out.append((np.cumsum(counts, dtype=np.uint32) - counts).astype("<u4").tobytes())
            rest = rest[goes_on]
    return levels, b"".join(out)


class Levels:
    """The codes of one segment; ``read`` gives so many bytes at an offset."""

    def __init__(self, levels: list[list[int]], offset: int, read: Read):
        self.n, self._read, self._levels = levels[0][1], read, []
        for number, (width, count) in enumerate(levels):
            bitmap = offset + -(-width * count // 8)
            ranks = bitmap + -(-count // 8)
            self._levels.append((width, offset, bitmap, ranks))
            if number + 1 < len(levels):
                offset = ranks + 4 * -(-count // RANK_PLACES)

    def _rank(self, bitmap: int, ranks: int, place: int) -> int:
        """Continuations before a place: an entry of the directory and at most 512 bits."""
        block, left = divmod(place, RANK_PLACES)
        if not left:
            # The place may be the end of the level, which has no entry.
            block, left = (block - 1, RANK_PLACES) if block else (0, 0)
        if not left:
            return 0
        entry = int.from_bytes(self._read(ranks + 4 * block, 4), "little")
        bits = int.from_bytes(self._read(bitmap + block * RANK_PLACES // 8, -(-left // 8)), "big")
        return entry + (bits >> (-left % 8)).bit_count()

    def one(self, place: int) -> int:
        """The id at a place."""
        value = shift = 0
        for number, (width, chunks, bitmap, ranks) in enumerate(self._levels):
            first, last = place * width // 8, -(-(place + 1) * width // 8)
            bits = int.from_bytes(self._read(chunks + first, last - first), "big")
            value |= (bits >> (last * 8 - (place + 1) * width) & (1 << width) - 1) << shift
            shift += width
            if number + 1 == len(self._levels) or not self._read(bitmap + place // 8, 1)[0] >> (7 - place % 8) & 1:
                return value
            place = self._rank(bitmap, ranks, place)
        return value

    def some(self, begin: int, end: int) -> np.ndarray:
        """The ids from one place to another."""
        out = np.zeros(end - begin, dtype=np.uint32)
        where, shift = None, 0
        for number, (width, chunks, bitmap, ranks) in enumerate(self._levels):
            if begin == end:
                break
            part = unpack(self._read, chunks, width, begin, end)
            if number == 0:
                out = part
            else:
                out[where] |= part << np.uint32(shift)
            shift += width
            if number + 1 < len(self._levels):
                goes_on = unpack(self._read, bitmap, 1, begin, end).astype(bool)
                begin = self._rank(bitmap, ranks, begin)
                where = where[goes_on] if number else np.flatnonzero(goes_on)
                end = begin + len(where)
        return out


class FileWriter:
    """Writes documents, in the order they come, to a stream."""

    def __init__(self, stream, segment: int = SEGMENT):
        self._stream, self._segment = stream, segment
        self._at, self._segments, self._held, self._n_held = len(_MAGIC), [], [], 0
        self.n_tokens, self._docs, self._starts = 0, [], []
        stream.write(_MAGIC)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self._docs.append(doc)
        self._starts.append(self.n_tokens)
        self.n_tokens += len(ids)
        for at in range(0, len(ids), self._segment):
            part = ids[at : at + self._segment]
            self._held.append(part)
            self._n_held += len(part)
            while self._n_held >= self._segment:
                joined = np.concatenate(self._held)
                self._write(joined[: self._segment])
                self._held, self._n_held = [joined[self._segment :]], len(joined) - self._segment

    def _write(self, ids: np.ndarray) -> None:
        levels, data = encode_levels(ids)
        self._segments.append({"offset": self._at, "levels": levels})
        self._stream.write(data)
        self._at += len(data)

    def finish(self) -> None:
        if self._n_held:
            self._write(np.concatenate(self._held))
        known = np.array([d is not None for d in self._docs], dtype=np.uint8)
        docs = np.array([d or 0 for d in self._docs], dtype="<i8")
        head = json.dumps({"n_docs": len(docs), "n_tokens": self.n_tokens, "segments": self._segments}).encode()
        footer = [len(head).to_bytes(8, "little"), head, known.tobytes(), docs.tobytes(), np.array(self._starts, dtype="<i8").tobytes()]
        for part in footer:
            self._stream.write(part)
        self._stream.write(self._at.to_bytes(8, "little") + _MAGIC)


class TokenFile:
    """An open file of token ids; places count from the file's first id."""

    def __init__(self, read: Read, size: int):
        trailer = read(size - _TRAILER, _TRAILER)
        if trailer[8:] != _MAGIC:
            raise ValueError("not a file of token codes")
        at = int.from_bytes(trailer[:8], "little")
        footer = read(at, size - _TRAILER - at)
        stop = 8 + int.from_bytes(footer[:8], "little")
        head = json.loads(footer[8:stop])
        n = head["n_docs"]
        self.n_tokens = head["n_tokens"]
        known = np.frombuffer(footer, np.uint8, n, stop)
        docs = np.frombuffer(footer, "<i8", n, stop + n)
        self.docs = [doc if there else None for doc, there in zip(docs.tolist(), known.tolist())]
        starts = np.frombuffer(footer, "<i8", n, stop + 9 * n).tolist()
        self.spans = list(zip(starts, [*starts[1:], self.n_tokens]))
        self._segments, self._firsts, first = [], [], 0
        for segment in head["segments"]:
            self._segments.append(Levels(segment["levels"], segment["offset"], read))
            self._firsts.append(first)
            first += self._segments[-1].n

    def token(self, place: int) -> int:
        """One id, by a few small reads."""
        if not 0 <= place < self.n_tokens:
            raise IndexError(place)
        segment = bisect_right(self._firsts, place) - 1
        return self._segments[segment].one(place - self._firsts[segment])

    def tokens(self, begin: int, end: int) -> np.ndarray:
        """The ids from one place to another."""
        parts = []
        while begin < end:
            segment = bisect_right(self._firsts, begin) - 1
            first = self._firsts[segment]
            stop = min(end, first + self._segments[segment].n)
            parts.append(self._segments[segment].some(begin - first, stop - first))
            begin = stop
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint32)

    def documents(self, at_once: int = SEGMENT) -> Iterator[tuple[list, list[tuple[int, int]], np.ndarray]]:
        """Documents a few at a time: ids of documents, their spans, and the token ids from the first to the last span."""
        at = 0
        while at < len(self.docs):
            stop = at + 1
            while stop < len(self.docs) and self.spans[stop][1] - self.spans[at][0] <= at_once:
                stop += 1
            yield self.docs[at:stop], self.spans[at:stop], self.tokens(self.spans[at][0], self.spans[stop - 1][1])
            at = stop
