"""Fuzzy digests and their scores (X06, X07), as Arrow column functions.

The per-value helpers follow the published papers: context-triggered piecewise hashing
(Kornblum, 2006) and the TLSH locality-sensitive hash (Oliver, Cheng, Chen, 2013). They work on
whole values with numpy; Spark splits, ships and joins the rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import as_col

# Fixed values of the piecewise hash.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
MIN_BLOCK = 3
SIGNATURE_CHARS = 64
WINDOW = 7
PIECE_SEED = 39  # low six bits of the hash seed 0x28021967
PIECE_FACTOR = 19  # low six bits of the hash prime 0x01000193
RUN = re.compile(r"(.)\1{3,}")
LONG_PIECE = 512  # bytes
TOGETHER_BYTES = 1 << 19  # contents of so many bytes are digested side by side
PAIRS_TOGETHER = 4096  # pairs scored side by side
_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)
_PADDING = len(ALPHABET)
_PLACES = np.full(256, 255, np.uint8)
_PLACES[_LETTERS] = np.arange(len(ALPHABET))
_PLACES[0] = _PADDING

# Fixed values of TLSH: (salt, offsets of the two older bytes next to the newest one).
TLSH_TRIPLETS = [(2, 1, 2), (3, 1, 3), (5, 2, 3), (7, 2, 4), (11, 1, 4), (13, 3, 4)]
TLSH_MIN_BYTES = 50
# A byte permutation by rule. Pass the published table where digests must equal those of another tool.
TLSH_PERMUTATION = tuple((167 * i + 13) % 256 ^ (((167 * i + 13) % 256) >> 3) for i in range(256))


def _window_sums(data: np.ndarray) -> np.ndarray:
    """The rolling value after every byte; it depends on the last seven bytes only."""
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32)])
    size = len(data)
    total = np.zeros(size, np.uint32)
    mixed = np.zeros(size, np.uint32)
    for age in range(WINDOW):
        byte = padded[WINDOW - 1 - age : WINDOW - 1 - age + size]
        total += byte * np.uint32(WINDOW - age + 1)  # plain sum plus sum weighted by freshness
        mixed ^= byte << np.uint32(5 * age)
    total += mixed
    return total


def _piece_states(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Six-bit piece hash after every byte, restarted at ``starts``, the first of which is 0.

    Bit k of the product depends on bit k and on lower bits, so each bit is a running XOR.
    """
    state = np.zeros(len(data), np.uint8)
    for bit in range(6):
        change = np.empty(len(data), np.uint8)
        change[1:] = state[:-1]
        change[starts] = PIECE_SEED & ((1 << bit) - 1)
        # Upper bits never reach lower ones, so bytes may overflow.
        change *= np.uint8(PIECE_FACTOR)
        change ^= data
        change >>= np.uint8(bit)
        change &= np.uint8(1)
        # Every piece begins by taking back the one before it.
        change[starts[1:]] ^= np.bitwise_xor.reduceat(change, starts)[:-1]
        change[0] ^= np.uint8(PIECE_SEED >> bit & 1)
        running = np.bitwise_xor.accumulate(change)
        running <<= np.uint8(bit)
        state |= running
    return state


def _piece_ends(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Six-bit hash of the pieces from ``starts`` to before ``ends``; pieces may lie anywhere and overlap.

    Pieces take a byte each in one step, those that are left first; the few long ones are hashed by bits.
    """
    lengths = ends - starts
    state = np.full(len(starts), PIECE_SEED, np.uint8)
    order = np.argsort(-lengths, kind="stable")
    many = int(np.count_nonzero(lengths > LONG_PIECE))
    long, order = order[:many], order[many:]
    if many:
        joined = np.concatenate([data[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist())])
        after = np.cumsum(lengths[long])
        state[long] = _piece_states(joined, after - lengths[long])[after - 1]
    left = np.searchsorted(-lengths[order], -np.arange(lengths[order[0]] if len(order) else 0), "left")
    begins, short = starts[order], state[order]
    for step, many in enumerate(left.tolist()):
        now = short[:many]
        now *= np.uint8(PIECE_FACTOR)
        now ^= data[begins[:many] + step]
    state[order] = short
    return state & 63


def _signatures(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, open_ends: np.ndarray, cuts: np.ndarray, owner: np.ndarray, limit: int) -> list[str]:
    """One signature per content, which lies in ``data`` from ``begins`` to before ``ends``; ``cuts`` are the
    last bytes of pieces, ``owner`` the contents they lie in, both in order."""
    many = np.bincount(owner, minlength=len(begins))
    before = np.cumsum(many) - many
    rank = np.arange(len(cuts)) - before[owner]
    last = np.where(many > 0, cuts[np.maximum(before + many - 1, 0)] if len(cuts) else 0, -1)
    used = rank < limit - 1
    taken, of = cuts[used], owner[used]
    kept = np.minimum(many, limit - 1)
    first = np.cumsum(kept) - kept
    # Every piece begins after the one before it. The rest is a piece too, open or up to the last cut.
    piece_starts = np.concatenate([[0], taken[:-1] + 1]) if len(taken) else taken
    piece_starts[first[kept > 0]] = begins[kept > 0]
    rest = np.where(kept > 0, taken[np.maximum(first + kept - 1, 0)] + 1 if len(taken) else 0, begins)
    rest_ends = np.where(open_ends, ends, np.where(many > limit - 1, last + 1, -1))
    has_rest = rest_ends >= 0
    states = _piece_ends(data, np.concatenate([piece_starts, rest[has_rest]]), np.concatenate([taken + 1, rest_ends[has_rest]]))
    chars = _LETTERS[states].tobytes().decode()
    tails = iter(chars[len(taken) :])
    return [chars[a : a + n] + (next(tails) if more else "") for a, n, more in zip(first.tolist(), kept.tolist(), has_rest.tolist())]


def _digests_together(contents: list[bytes]) -> list[str]:
    """Digests of contents that are not empty, side by side with zeros between them, which a new window begins with."""
    gap = bytes(WINDOW - 1)
    data = np.frombuffer(gap + gap.join(contents), np.uint8)
    lengths = np.array([len(c) for c in contents])
    ends = np.cumsum(lengths + len(gap))
    begins = ends - lengths
    rolling = _window_sums(data)
    rolling[(begins[:, None] - np.arange(1, WINDOW)).ravel()] = 0
    # A byte ends a piece where its value plus one divides by the block, which is 3 times a power of two.
    cuts = np.flatnonzero(rolling % np.uint32(MIN_BLOCK) == MIN_BLOCK - 1)
    parts = (rolling[cuts].astype(np.int64) + 1) // MIN_BLOCK
    level = np.bitwise_count((parts & -parts) - 1).astype(np.int64)
    owner = np.repeat(np.arange(len(contents)), lengths + len(gap))[cuts]
    known = np.bincount(owner * 64 + level, minlength=64 * len(contents)).reshape(-1, 64)
    at_least = np.cumsum(known[:, ::-1], axis=1)[:, ::-1]
    levels = []
    for size, many in zip(lengths.tolist(), at_least):
        step = 0
        while (MIN_BLOCK << step) * SIGNATURE_CHARS < size:
            step += 1
        while step and many[step] < SIGNATURE_CHARS // 2:
            step -= 1
        levels.append(step)
    wanted = np.array(levels)
    open_ends = rolling[ends - 1] != 0
    both = []
    for more, limit in ((0, SIGNATURE_CHARS), (1, SIGNATURE_CHARS // 2)):
        ending = level >= wanted[owner] + more
        both.append(_signatures(data, begins, ends, open_ends, cuts[ending], owner[ending], limit))
    return [f"{MIN_BLOCK << step}:{first}:{second}" for step, first, second in zip(levels, *both)]


def piecewise_digests(contents: Iterable[bytes | None]) -> list[str | None]:
    """Digests of many contents, some of them at a time; null has none."""
    found, at, together, size = [], [], [], 0
    for content in contents:
        if content:
            if together and size + len(content) > TOGETHER_BYTES:
                for place, digest in zip(at, _digests_together(together)):
                    found[place] = digest
                at, together, size = [], [], 0
            at.append(len(found))
            together.append(content)
            size += len(content)
        found.append(None if content is None else f"{MIN_BLOCK}::")
    for place, digest in zip(at, _digests_together(together) if together else []):
        found[place] = digest
    return found


def piecewise_digest(content: bytes) -> str:
    return piecewise_digests([content])[0]


def _common_length(left: str, right: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    places: dict[str, int] = {}
    for at, char in enumerate(left):
        places[char] = places.get(char, 0) | 1 << at
    full = (1 << len(left)) - 1
    row = full
    for char in right:
        hits = row & places.get(char, 0)
        row = ((row + hits) | (row - hits)) & full
    return len(left) - row.bit_count()


def _signature_score(left: str, right: str, block: int) -> int:
    pieces = {left[i : i + WINDOW] for i in range(len(left) - WINDOW + 1)}
    if not any(right[i : i + WINDOW] in pieces for i in range(len(right) - WINDOW + 1)):
        return 0
    distance = len(left) + len(right) - 2 * _common_length(left, right)
    score = 100 - 100 * (distance * SIGNATURE_CHARS // (len(left) + len(right))) // SIGNATURE_CHARS
    if block < (99 + WINDOW) // WINDOW * MIN_BLOCK:
        score = min(score, block // MIN_BLOCK * min(len(left), len(right)))
    return score


def piecewise_score(left: str, right: str) -> int:
    """Similarity of two piecewise digests, 0 to 100."""
    (block_a, rest_a), (block_b, rest_b) = left.split(":", 1), right.split(":", 1)
    a, b = int(block_a), int(block_b)
    first_a, second_a = RUN.sub(r"\1\1\1", rest_a).split(":")
    first_b, second_b = RUN.sub(r"\1\1\1", rest_b).split(":")
    if a == b:
        if first_a == first_b and second_a == second_b:
            return 100
        return max(_signature_score(first_a, first_b, a), _signature_score(second_a, second_b, 2 * a))
    if a == 2 * b:
        return _signature_score(first_a, second_b, a)
    if b == 2 * a:
        return _signature_score(second_a, first_b, b)
    return 0


def _signature_scores(codes: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, block: np.ndarray) -> np.ndarray:
    """``_signature_score`` of many pairs of signatures, given as rows of ``codes``, all of which take one character per step."""
    rows, at = np.unique(left, return_inverse=True)
    # Where each character is in the left signature, as bits.
    places = np.zeros((len(rows), _PADDING + 1), np.uint64)
    every = np.arange(len(rows))
    for place in range(int(sizes[left].max(initial=0))):
        places[every, codes[rows, place]] |= np.uint64(1 << place)
    places[:, _PADDING] = 0
    places, base = places.ravel(), at * (_PADDING + 1)
    chars = np.ascontiguousarray(codes[right].T)
    row = np.full(len(left), ~np.uint64(0))
    shared = np.zeros(len(left), np.uint64)
    one, two = [np.zeros(len(left), np.uint64)] * (WINDOW - 1), [np.zeros(len(left), np.uint64)] * 4
    for char in chars[: int(sizes[right].max(initial=0))]:
        hits = places[base + char]
        # Ends of equal pieces of 2 characters, then of 4, 6 and 7.
        twice = hits & (one[-1] << np.uint64(1))
        shared |= twice & (two[-2] << np.uint64(2)) & (two[-4] << np.uint64(4)) & (one[-6] << np.uint64(6))
        one, two = [*one[1:], hits], [*two[1:], twice]
        hits = row & hits
        row = (row + hits) | (row - hits)
    total = sizes[left] + sizes[right]
    distance = total - 2 * (SIGNATURE_CHARS - np.bitwise_count(row).astype(np.int64))
    score = 100 - 100 * (distance * SIGNATURE_CHARS // np.maximum(total, 1)) // SIGNATURE_CHARS
    capped = np.minimum(score, block // MIN_BLOCK * np.minimum(sizes[left], sizes[right]))
    score = np.where(block < (99 + WINDOW) // WINDOW * MIN_BLOCK, capped, score)
    return np.where(shared != 0, score, 0)


class ReadDigests:
    """Piecewise digests, each read once, to be scored in pairs."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.blocks, self.plain = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        sizes, joined = [], []
        for at, text in enumerate(texts):
            block, rest = text.split(":", 1)
            parts = [part.encode() for part in RUN.sub(r"\1\1\1", rest).split(":")]
            if len(parts) != 2 or max(map(len, parts)) > SIGNATURE_CHARS or "\0" in rest or not 0 <= int(block) < 1 << 48:
                self.plain[at], block, parts = True, 0, [b"", b""]
            self.blocks[at] = int(block)
            sizes += map(len, parts)
            joined += [part.ljust(SIGNATURE_CHARS, b"\0") for part in parts]
        # First and second signatures in turn.
        codes = _PLACES[np.frombuffer(b"".join(joined), np.uint8)].reshape(-1, SIGNATURE_CHARS)
        self.plain |= (codes == 255).any(axis=1).reshape(-1, 2).any(axis=1)
        self.codes, self.sizes = np.minimum(codes, _PADDING), np.array(sizes, np.int64)

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``piecewise_score`` of pairs of places."""
        pieces = [self._some(a[at : at + PAIRS_TOGETHER], b[at : at + PAIRS_TOGETHER]) for at in range(0, len(a), PAIRS_TOGETHER)]
        return np.concatenate([np.empty(0, np.int32), *pieces])

    def _some(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        block_a, block_b = self.blocks[a], self.blocks[b]
        same = block_a == block_b
        above, below = ~same & (block_a == 2 * block_b), ~same & (block_b == 2 * block_a)
        found = np.zeros(len(a), np.int32)
        for which, left, right, block in (
            (same, 2 * a, 2 * b, block_a),
            (same, 2 * a + 1, 2 * b + 1, 2 * block_a),
            (above, 2 * a, 2 * b + 1, block_a),
            (below, 2 * b, 2 * a + 1, block_b),
        ):
            if (own := np.flatnonzero(which)).size:
                scores = _signature_scores(self.codes, self.sizes, left[own], right[own], block[own])
                found[own] = np.maximum(found[own], scores)
        equal = np.flatnonzero(same & (self.sizes[2 * a] == self.sizes[2 * b]) & (self.sizes[2 * a + 1] == self.sizes[2 * b + 1]))
        codes = self.codes.reshape(-1, 2 * SIGNATURE_CHARS)
        found[equal[(codes[a[equal]] == codes[b[equal]]).all(axis=1)]] = 100
        for odd in np.flatnonzero(self.plain[a] | self.plain[b]):
            found[odd] = piecewise_score(self.texts[a[odd]], self.texts[b[odd]])
        return found


def piecewise_scores(lefts: pa.Array, rights: pa.Array) -> pa.Array:
    """``piecewise_score`` of many pairs; null has no score."""
    many = len(lefts)
    named = pa.concat_arrays([lefts.cast(pa.string()), rights.cast(pa.string())]).dictionary_encode()
    known = named.indices.is_valid().to_numpy(zero_copy_only=False)
    known = known[:many] & known[many:]
    places = named.indices.fill_null(0).to_numpy().astype(np.int64)
    out = np.zeros(many, np.int32)
    out[known] = ReadDigests(named.dictionary.to_pylist()).scores(places[:many][known], places[many:][known])
    return pa.array(out, mask=~known)


def tlsh_value(content: bytes, permutation=TLSH_PERMUTATION) -> str | None:
    """TLSH digest, or null where the content is too short or too uniform to have one."""
    data = np.frombuffer(content, np.uint8)
    if len(data) < TLSH_MIN_BYTES:
        return None
    table = np.array(permutation, np.uint8)
    newest = data[4:]
    counts = np.zeros(256, np.int64)
    for salt, second, third in TLSH_TRIPLETS:
        mixed = table[table[salt] ^ newest]
        mixed = table[mixed ^ data[4 - second : len(data) - second]]
        mixed = table[mixed ^ data[4 - third : len(data) - third]]
        counts += np.bincount(mixed, minlength=256)
    buckets = counts[:128]
    ordered = np.sort(buckets)
    low, middle, high = int(ordered[31]), int(ordered[63]), int(ordered[95])
    if high == 0 or np.count_nonzero(buckets) <= 64:
        return None
    checksum = 0
    for mixed in table[table[table[0] ^ newest] ^ data[3:-1]].tolist():
        checksum = permutation[mixed ^ checksum]
    size = len(data)
    if size <= 656:
        length = math.floor(math.log(size) / math.log(1.5))
    elif size <= 3199:
        length = math.floor(math.log(size) / math.log(1.3) - 8.72777)
    else:
        length = math.floor(math.log(size) / math.log(1.1) - 62.5472)
    codes = (buckets > low).astype(np.uint8) + (buckets > middle) + (buckets > high)
    body = (codes.reshape(32, 4) << np.array([0, 2, 4, 6])).sum(axis=1)[::-1]
    ratios = (low * 100 // high) % 16 | ((middle * 100 // high) % 16) << 4
    head = [checksum, length & 255, ratios]
    swapped = [(b & 15) << 4 | b >> 4 for b in head]
    return "T1" + bytes(swapped + body.tolist()).hex().upper()


def tlsh_distance(left: str, right: str) -> int:
    """Distance of two TLSH digests; 0 is the same."""
    a, b = bytes.fromhex(left[2:]), bytes.fromhex(right[2:])
    a_head, b_head = ([(v & 15) << 4 | v >> 4 for v in x[:3]] for x in (a, b))

    def around(x: int, y: int, size: int) -> int:
        gap = abs(x - y)
        return min(gap, size - gap)

    length = around(a_head[1], b_head[1], 256)
    total = length if length <= 1 else length * 12
    for shift in (0, 4):
        gap = around(a_head[2] >> shift & 15, b_head[2] >> shift & 15, 16)
        total += gap if gap <= 1 else (gap - 1) * 12
    total += a_head[0] != b_head[0]
    for x, y in zip(a[3:], b[3:]):
        for shift in (0, 2, 4, 6):
            gap = abs((x >> shift & 3) - (y >> shift & 3))
            total += 6 if gap == 3 else gap
    return int(total)


@F.arrow_udf(T.StringType())
def _digests(contents: pa.Array) -> pa.Array:
    return pa.array(piecewise_digests(content.as_py() for content in contents), pa.string())


def piecewise_digest_of(content: Column | str) -> Column:
    return _digests(as_col(content).cast("binary"))


def tlsh_digest_of(content: Column | str, permutation=TLSH_PERMUTATION) -> Column:
    table = tuple(permutation)

    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        return values.map(lambda v: tlsh_value(v, table), na_action="ignore")

    return digest(as_col(content).cast("binary"))


@F.arrow_udf(T.IntegerType())
def _scores(lefts: pa.Array, rights: pa.Array) -> pa.Array:
    return piecewise_scores(lefts, rights)


def piecewise_score_of(left: Column | str, right: Column | str) -> Column:
    return _scores(as_col(left), as_col(right))


def tlsh_distance_of(left: Column | str, right: Column | str) -> Column:
    @F.pandas_udf("int")
    def distance(lefts: pd.Series, rights: pd.Series) -> pd.Series:
        return pd.Series([tlsh_distance(a, b) for a, b in zip(lefts, rights)], dtype="int32")

    return distance(as_col(left), as_col(right))
