"""Byte strings that occur more than once, removed from all texts (operator 3).

Suffixes are told apart by their first 400 bytes. As in bucket-pointer refinement they start in buckets of their first
q = 100 bytes; a bucket of length l is refined by the bucket that its suffixes have l bytes later, and the refined
buckets are used for the next step: 100, 200, 400. Bucket identifiers are fingerprints of the bytes, so that a task
refines its own texts without asking anybody, and only the question which buckets hold several suffixes
is put to all.

It is put for few suffixes. Of the 301 buckets of 100 bytes that lie within a suffix's 400 bytes, the one with the
smallest identifier is its seed. Suffixes in a row with one seed are a run, and equal suffixes have equal seeds at equal places.
First the seeds of all runs meet, each with a fingerprint of its whole run. A seed that comes once is done: its suffixes
are alone. Equal runs are done too: all their suffixes have several occurrences. Where a seed has different runs,
their suffixes are refined to 400 bytes, one representative per run, and these buckets meet.

Documents are held in groups of a few megabytes; a group sends each identifier once, packed per destination, and gets back
what it needs to know of its own. Texts move once, to their group.

Cases: a null text is empty; texts shorter than 400 bytes keep all bytes; every row is a document of its own, so repeated
rows of 400 bytes or more lose everything. Null ids stay null. Identifiers are fingerprints modulo 2 ** 61 - 1: two
different strings of n bytes share one for n of its 2 ** 61 bases at most, and seeds and runs are told apart by different bases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Fingerprints, byte_values, mixed, text_rows

LENGTH = 400
FIRST = 100  # LENGTH is FIRST doubled twice
GROUP_BYTES = 4 << 20
STRETCH_BYTES = 1 << 19
BUCKET_KEYS = 1 << 21

_SENT = pa.schema([("bucket", pa.int32()), ("part", pa.int64()), ("once", pa.binary()), ("several", pa.binary())])
_SENT_DDL = "bucket int, part long, once binary, several binary"
_KNOWN = pa.schema([("part", pa.int64()), ("keys", pa.binary()), ("mixed", pa.binary())])
_KNOWN_DDL = "part long, keys binary, mixed binary"
_RUN = np.dtype([("seed", "<u8"), ("run", "<u8")])
_KEPT = pa.schema(
    [("id", pa.int64()), ("n_bytes", pa.int64()), ("span_starts", pa.list_(pa.int64())), ("span_ends", pa.list_(pa.int64())), ("kept", pa.binary())]
)
_KEPT_DDL = "id long, n_bytes long, span_starts array<long>, span_ends array<long>, kept binary"


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The best of every ``width`` neighbours, by running bests from both ends of blocks of that width."""
    count = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.empty(blocks * width, dtype=values.dtype)
    padded[: len(values)] = values
    padded[len(values) :] = values[-1]
    padded = padded.reshape(blocks, width)
    ahead = best.accumulate(padded, axis=1).ravel()
    behind = best.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:count], ahead[width - 1 : width - 1 + count])


_PLACE = np.uint64((1 << 20) - 1)


class _Stretch:
    """Bytes of one document or several: runs of suffixes with their seeds, and the refined buckets."""

    def __init__(self, texts: list[bytes]):
        self.lengths = [len(t) for t in texts]
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.names = Fingerprints(data).grams(FIRST)
        n = sum(self.lengths)
        # A suffix must have LENGTH bytes left in its own text.
        left = np.repeat(np.cumsum(self.lengths), self.lengths) - np.arange(n)
        fits = left[: n - LENGTH + 1] >= LENGTH
        # Identifiers with their places: of equal ones the first counts, which depends on the suffix's bytes only.
        placed = (self.names & ~_PLACE) | np.arange(len(self.names), dtype=np.uint64)
        at = (_sliding(placed, LENGTH - FIRST + 1, np.minimum) & _PLACE).astype(np.int64)
        turn = np.concatenate([[True], (at[1:] != at[:-1]) | (fits[1:] != fits[:-1])])
        first = np.flatnonzero(turn)
        last = np.concatenate([first[1:], [len(at)]]) - 1
        own = fits[first]
        self.first, self.last = first[own], last[own]
        self.runs = np.empty(len(self.first), dtype=_RUN)
        self.runs["seed"] = self.names[at[self.first]]
        # Of another base: where two seeds are confused, their runs are not.
        self.runs["run"] = Fingerprints(data, 1).of(self.first, self.last + LENGTH)

    def refined(self) -> np.ndarray:
        """The 400-byte buckets: each step refines by the bucket that begins where the last one ends."""
        names, length = self.names, FIRST
        while length < LENGTH:
            names = mixed(mixed(names[:-length]) + names[length:] * np.uint64(0x9E3779B97F4A7C15))
            length *= 2
        return names


def _stretches(texts: list[bytes]) -> Iterator[tuple[list[int], int, _Stretch]]:
    """``(documents, offset, stretch)``: short texts together, long ones in pieces that overlap so that
    every suffix is in exactly one."""
    together, size = [], 0
    for at, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        if len(text) > STRETCH_BYTES:
            for start in range(0, len(text) - LENGTH + 1, STRETCH_BYTES):
                yield [at], start, _Stretch([text[start : start + STRETCH_BYTES + LENGTH - 1]])
            continue
        if size + len(text) > STRETCH_BYTES and together:
            yield together, 0, _Stretch([texts[i] for i in together])
            together, size = [], 0
        together.append(at)
        size += len(text)
    if together:
        yield together, 0, _Stretch([texts[i] for i in together])


class _Members:
    """Is a number among known ones? A small table of bits answers most questions with no."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.mask = np.uint64((1 << max(16, min(24, int(len(keys)).bit_length() + 3))) - 1)
        self.bits = np.zeros(int(self.mask) + 1, dtype=bool)
        self.bits[(self.keys & self.mask).astype(np.int64)] = True

    def places(self, values: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.empty(0, dtype=np.int64)
        maybe = np.flatnonzero(self.bits[(values & self.mask).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, values[maybe]), len(self.keys) - 1)
        return maybe[self.keys[at] == values[maybe]]


def _by_bucket(part: int, values: np.ndarray, keys: np.ndarray, several: np.ndarray, buckets: int) -> pa.Table:
    """Rows of one group: for every bucket of the keys what it has once, and what it has several times."""
    bucket = (mixed(keys) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    values, several, bucket = values[order], several[order], bucket[order]
    some, first = np.unique(bucket, return_index=True)
    once, more = [], []
    for a, b in zip(first, [*first[1:], len(bucket)]):
        own, double = values[a:b], several[a:b]
        once.append(own[~double].tobytes())
        more.append(own[double].tobytes())
    return pa.table([pa.array(some), pa.array([part] * len(some), pa.int64()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], schema=_SENT)


def _texts(table: pa.Table) -> list[bytes]:
    return byte_values(table.column("text").combine_chunks()) if table.num_rows else []


def _send_runs(buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        runs = [np.empty(0, dtype=_RUN), *(s.runs for _, _, s in _stretches(_texts(table)))]
        values, counts = np.unique(np.concatenate(runs), return_counts=True)
        return _by_bucket(key[0].as_py(), values, values["seed"], counts > 1, buckets)

    return run


def _meet_runs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For every group: which of its runs occur several times, and which it must refine."""
    columns = [[np.frombuffer(x, dtype=_RUN) for x in table.column(c).to_pylist()] for c in ("once", "several")]
    lengths = [len(a) + len(b) for a, b in zip(*columns)]
    runs = np.concatenate([x for pair in zip(*columns) for x in pair])
    doubled = np.concatenate([np.full(len(x), flag) for pair in zip(*columns) for x, flag in zip(pair, (False, True))]).astype(bool)
    holder = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((holder, runs["run"], runs["seed"]))
    seed, run, doubled, holder = runs["seed"][order], runs["run"][order], doubled[order], holder[order]
    new_seed = np.concatenate([[True], seed[1:] != seed[:-1]])
    new_run = np.concatenate([[True], new_seed[1:] | (run[1:] != run[:-1])])
    run_no, seed_no = np.cumsum(new_run) - 1, np.cumsum(new_seed) - 1
    repeated = (np.bincount(run_no, weights=1 + doubled) > 1)[run_no]
    several_runs = (np.bincount(seed_no, weights=new_run) > 1)[seed_no]
    refine = new_run & several_runs  # the first holder of a run stands for all
    rows = []
    for part, at in zip(table.column("part").to_pylist(), _places_of(holder, len(lengths))):
        if len(at):
            rows.append((part, run[at[repeated[at]]].tobytes(), run[at[refine[at]]].tobytes()))
    return _known_table(rows)


def _places_of(holder: np.ndarray, count: int) -> list[np.ndarray]:
    order = np.argsort(holder, kind="stable")
    return np.split(order, np.cumsum(np.bincount(holder, minlength=count))[:-1])


def _known_table(rows: list[tuple]) -> pa.Table:
    rows = [r for r in rows if r[1] or r[2]]
    columns = zip(*rows) if rows else ([], [], [])
    return pa.table([pa.array(c, t.type) for c, t in zip(columns, _KNOWN)], schema=_KNOWN)


def _meet_suffixes(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For every group: which of the refined buckets it asked for hold several suffixes."""
    once, several = ([np.frombuffer(x, dtype="<u8") for x in table.column(c).to_pylist()] for c in ("once", "several"))
    values = np.sort(np.concatenate(once))
    members = _Members(np.concatenate([values[1:][values[1:] == values[:-1]], *several]))
    parts = table.column("part").to_pylist()
    return _known_table([(p, np.concatenate([a[members.places(a)], b]).tobytes(), b"") for p, a, b in zip(parts, once, several)])


def _known(table: pa.Table, column: str) -> _Members:
    parts = [np.frombuffer(x, dtype="<u8") for x in table.column(column).to_pylist()] if table.num_rows else []
    return _Members(np.concatenate([np.empty(0, dtype=np.uint64), *parts]))


def _places(stretch: _Stretch, runs: np.ndarray) -> np.ndarray:
    """Places of all suffixes of some runs."""
    first, length = stretch.first[runs], stretch.last[runs] - stretch.first[runs] + 1
    return np.repeat(first - np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64), length) + np.arange(length.sum())


def _send_suffixes(buckets: int):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        keys, refine, done = [np.empty(0, dtype=np.uint64)], _known(right, "mixed"), set()
        for _, _, stretch in _stretches(_texts(left)) if len(refine.keys) else ():
            # Equal runs of one group ask once.
            runs = [r for r in refine.places(stretch.runs["run"]).tolist() if stretch.runs["run"][r] not in done]
            if runs:
                _, lone = np.unique(stretch.runs["run"][runs], return_index=True)
                runs = np.array(runs)[lone]
                done.update(stretch.runs["run"][runs].tolist())
                keys.append(stretch.refined()[_places(stretch, runs)])
        values, counts = np.unique(np.concatenate(keys), return_counts=True)
        return _by_bucket(key[0].as_py(), values, values, counts > 1, buckets)

    return run


def _remove(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
    """Cut out of every text what lies under a suffix that occurs several times."""
    texts = _texts(left)
    found: list[list[np.ndarray]] = [[] for _ in texts]
    # Kind 0 tells of runs, kind 1 of suffixes.
    flag = pc.equal(right.column("kind"), 0) if right.num_rows else None
    repeated, refined, several = (
        (_known(right.filter(flag), "keys"), _known(right.filter(flag), "mixed"), _known(right.filter(pc.invert(flag)), "keys"))
        if right.num_rows else (_known(right, "keys"),) * 3
    )
    for docs, offset, stretch in _stretches(texts) if len(repeated.keys) + len(several.keys) else ():
        places = [_places(stretch, repeated.places(stretch.runs["run"]))]
        if len(several.keys):
            asked = _places(stretch, refined.places(stretch.runs["run"]))
            places.append(asked[several.places(stretch.refined()[asked])])
        places = np.unique(np.concatenate(places))
        begin = np.concatenate([[0], np.cumsum(stretch.lengths)])
        cuts = np.searchsorted(places, begin)
        for n, doc in enumerate(docs):
            if cuts[n] < cuts[n + 1]:
                found[doc].append(places[cuts[n] : cuts[n + 1]] - begin[n] + offset)
    starts, ends, kept = [], [], []
    for text, parts in zip(texts, found):
        if not parts:
            starts.append([])
            ends.append([])
            kept.append(text)
            continue
        places = np.sort(np.concatenate(parts))
        first = np.concatenate([[True], places[1:] > places[:-1] + LENGTH])
        begin = places[first]
        end = places[np.concatenate([first[1:], [True]])] + LENGTH
        starts.append(begin)
        ends.append(end)
        kept.append(b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(text)])))
    ids = left.column("id").combine_chunks() if left.num_rows else pa.array([], pa.int64())
    columns = [ids, *(pa.array(c, t.type) for c, t in zip(([len(t) for t in texts], starts, ends, kept), list(_KEPT)[1:]))]
    return pa.table(columns, schema=_KEPT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, span_starts, span_ends, kept)`` of every row: the maximal removed runs of bytes, and what is left."""
    rows = text_rows(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), "text")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    parts, buckets = int(total // GROUP_BYTES + 1), int(total // 4 // BUCKET_KEYS + 12)
    placed = rows.select("id", "text", F.pmod(F.xxhash64("id", "text"), F.lit(parts)).alias("part"))
    grouped = placed.groupBy("part")

    runs = grouped.applyInArrow(_send_runs(buckets), _SENT_DDL).groupBy("bucket").applyInArrow(_meet_runs, _KNOWN_DDL)
    sent = grouped.cogroup(runs.groupBy("part")).applyInArrow(_send_suffixes(buckets), _SENT_DDL)
    suffixes = sent.groupBy("bucket").applyInArrow(_meet_suffixes, _KNOWN_DDL)
    known = runs.withColumn("kind", F.lit(0)).unionByName(suffixes.withColumn("kind", F.lit(1)))
    return grouped.cogroup(known.groupBy("part")).applyInArrow(_remove, _KEPT_DDL)
