"""Near-duplicate vectors by spherical-cap filters (operator 2).

A filter is a direction; a vector belongs to it if their inner product exceeds a threshold. Directions
come from a random product code: after a random rotation the space is cut into ``PARTS`` parts of
equal dimension, each with its own small code of unit vectors, and a direction takes one code word
from each part. The filters of a vector are found by list decoding: per part the code words are
sorted by their inner product, and partial choices are dropped as soon as even the best rest
cannot reach the threshold. Vectors meet in their common filters and every pair there is verified by its
cosine in double precision, so a link is never wrong. A vector also belongs to its ``BEST`` best directions, whether or
not they reach the threshold, so each has filters, and several codes, drawn independently, are used side by side.

A pair is missed only if no filter of any code holds both. Codes are turned at random, so the chance of that depends on
nothing but the pair's cosine: it is measured on ``PROBES`` random pairs right at the least cosine, and codes are added
until at most one in ``1 / MISSED`` of those is missed; where ``MOST_CODES`` do not get there, all pairs are compared.
``exact`` asks for that with up to so many distinct vectors; by default tables of every size go through the codes.

Equal vectors are one node with a count. A filter with many members is cut into slices of ``SLICE`` vectors,
and every pair of slices is a task of its own: no filter is gathered anywhere, none is cut off. A
pair counts in its lowest common filter only, so links are counted, and chained to components,
inside the slices and no list of pairs is ever made.

Cases: vectors that are null, zero, or hold null or non-finite components link with nothing. Vectors of different lengths
never link; each length has codes and filters of its own. Rows with the same id and vector are copies: each
links with the others. A row without an id takes part, and its component is named by the smallest id in it, if there is one.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.similarity import connected_components
from ..session import work_root
from .common import batch_of, sliced

MIN_COSINE = 0.95
PARTS = 2
FILTERS = 12.0  # of each code, on average
BEST = 12
BUCKET = 200
SLICE = 512
SEED = 20
EXACT = 0
LEAST_CODES, MOST_CODES = 2, 64
PROBES, MISSED = 4_000, 0.0005
SAMPLED_DIRECTIONS = 40_000


class ProductCode:
    """Filter directions as sums of one code word per part, and the list decoder."""

    def __init__(self, dimension: int, nodes: int, parts: int = PARTS, filters: float = FILTERS, bucket: int = BUCKET, seed: int = SEED):
        """The code is as large as it takes for about ``bucket`` of the ``nodes`` vectors per filter."""
        self.parts = min(parts, dimension)
        wanted = max(4.0 * filters, nodes * filters / bucket)
        self.words = int(np.ceil(wanted ** (1 / self.parts)))
        random = np.random.default_rng(seed)
        self.rotation = np.linalg.qr(random.normal(size=(dimension, dimension)))[0]
        self.cuts = np.linspace(0, dimension, self.parts + 1).astype(int)
        self.codes = []
        for a, b in zip(self.cuts, self.cuts[1:]):
            words = random.normal(size=(self.words, b - a))
            self.codes.append(words / np.linalg.norm(words, axis=1, keepdims=True) / np.sqrt(self.parts))
        # The threshold that a random unit vector exceeds for ``filters`` directions on average.
        sample = random.normal(size=(400, dimension))
        sample /= np.linalg.norm(sample, axis=1, keepdims=True)
        products = self._products(sample)
        directions = self.words**self.parts
        if directions <= SAMPLED_DIRECTIONS:
            total = products[0]
            for more in products[1:]:
                total = (total[:, :, None] + more[:, None, :]).reshape(len(sample), -1)
        else:
            total = sum(p[:, random.integers(self.words, size=SAMPLED_DIRECTIONS)] for p in products)
        self.threshold = float(np.quantile(total, 1 - min(0.5, filters / directions)))

    def _products(self, vectors: np.ndarray) -> list[np.ndarray]:
        turned = vectors @ self.rotation
        return [turned[:, a:b] @ code.T for (a, b), code in zip(zip(self.cuts, self.cuts[1:]), self.codes)]

    def filters_of(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, filter)`` of every exceeding direction, by row and filter."""
        products = self._products(vectors)
        best_rest = np.zeros((self.parts + 1, len(vectors)))
        for part in range(self.parts - 1, -1, -1):
            best_rest[part] = best_rest[part + 1] + products[part].max(axis=1)
        row, name, reached = np.arange(len(vectors)), np.zeros(len(vectors), dtype=np.int64), np.zeros(len(vectors))
        for part in range(self.parts):
            # A choice goes on with the code words that can still reach the threshold.
            values = reached[:, None] + products[part][row]
            at, word = np.nonzero(values >= self.threshold - best_rest[part + 1][row][:, None])
            row, name, reached = row[at], name[at] * self.words + word, values[at, word]
        return row, name

    def best_of(self, vectors: np.ndarray, best: int) -> np.ndarray:
        """The ``best`` directions of greatest inner product of every row."""
        reached, name = np.zeros((len(vectors), 1)), np.zeros((len(vectors), 1), dtype=np.int64)
        for products in self._products(vectors):
            # What is not among the best of the first parts, or of this one, is not among the best of all.
            few = min(best, self.words)
            word = np.argpartition(-products, few - 1, axis=1)[:, :few]
            values = (reached[:, :, None] + np.take_along_axis(products, word, 1)[:, None, :]).reshape(len(vectors), -1)
            names = (name[:, :, None] * self.words + word[:, None, :]).reshape(len(vectors), -1)
            top = np.argpartition(-values, min(best, values.shape[1]) - 1, axis=1)[:, :best]
            reached, name = np.take_along_axis(values, top, 1), np.take_along_axis(names, top, 1)
        return name


class Codes:
    """Independent codes over vectors of one length, as many as it takes; none if all pairs are compared."""

    def __init__(self, dimension: int, nodes: int, min_cosine: float = MIN_COSINE, exact: int = EXACT, best: int = BEST, seed: int = SEED, **code_options):
        self.best, self.codes, self.missed = best, [], 0.0
        if nodes <= exact or dimension == 1:
            return
        random = np.random.default_rng(seed)
        a, b = random.normal(size=(2, PROBES, dimension))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b = min_cosine * a + np.sqrt(max(0.0, 1 - min_cosine**2)) * b / np.linalg.norm(b, axis=1, keepdims=True)
        apart = np.ones(PROBES, dtype=bool)
        while len(self.codes) < LEAST_CODES or (apart.mean() > MISSED and len(self.codes) < MOST_CODES):
            self.codes.append(ProductCode(dimension, nodes, seed=seed + 1 + len(self.codes), **code_options))
            for start in range(0, PROBES, 64):
                some = slice(start, start + 64)
                (row_a, name_a), (row_b, name_b) = (self._of_code(self.codes[-1], x[some]) for x in (a, b))
                pairs_a, pairs_b = (np.stack(x, axis=1).view("i8,i8").ravel() for x in ((row_a, name_a), (row_b, name_b)))
                apart[np.intersect1d(pairs_a, pairs_b)["f0"] + start] = False
        self.missed = float(apart.mean())
        if self.missed > MISSED:
            warnings.warn(f"{MOST_CODES} codes miss {self.missed:.2%} of the pairs at a cosine of {min_cosine}: all pairs are compared", stacklevel=2)
            self.codes = []

    def _of_code(self, code: ProductCode, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, name = code.filters_of(vectors)
        best = code.best_of(vectors, self.best)
        row = np.concatenate([row, np.repeat(np.arange(len(vectors)), best.shape[1])])
        name = np.concatenate([name, best.ravel()])
        order = np.lexsort((name, row))
        row, name = row[order], name[order]
        fresh = np.ones(len(row), dtype=bool)
        fresh[1:] = (row[1:] != row[:-1]) | (name[1:] != name[:-1])
        return row[fresh], name[fresh]

    def count(self) -> int:
        """How many filters there are."""
        return max(1, sum(code.words**code.parts for code in self.codes))

    def filters_of(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, filter)`` of every vector in every code, by row and filter."""
        if not self.codes:
            return np.arange(len(vectors)), np.zeros(len(vectors), dtype=np.int64)
        rows, names, before = [], [], 0
        for code in self.codes:
            row, name = self._of_code(code, vectors)
            rows.append(row)
            names.append(name + before)
            before += code.words**code.parts
        row, name = np.concatenate(rows), np.concatenate(names)
        order = np.lexsort((name, row))
        return row[order], name[order]


def _node_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, vector)`` with vectors as doubles; unusable ones become null."""
    raw = F.col(f"`{vector_col}`").cast("array<double>")
    sound = ~F.exists(raw, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(raw, lambda x: x != 0)
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.when(F.coalesce(sound, F.lit(False)), raw).alias("vector"))


def _of_one_length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches of vectors of one length."""
    for batch in batches:
        lengths = pc.list_value_length(batch.column("vector"))
        for length in pc.unique(lengths):
            yield from sliced([batch.filter(pc.equal(lengths, length))], 64)


def _decode(shared):
    schema = pa.schema([("filter", pa.int64()), ("node", pa.int64()), ("copies", pa.int64()), ("vector", pa.list_(pa.float64())), ("filters", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Every length has filter numbers of its own.
        codes, before = {}, 0
        for length, code in shared.value:
            codes[length] = code, before
            before += code.count()
        for batch in _of_one_length(batches):
            matrix = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            scale = np.abs(matrix).max(axis=1, keepdims=True)
            unit = matrix / scale
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            code, first = codes[matrix.shape[1]]
            row, name = code.filters_of(unit)
            name = name + first
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            own = [name[a:b] for a, b in zip(ends, ends[1:])]
            node, copies = batch.column("node").to_numpy(), batch.column("copies").to_numpy()
            for start in range(0, len(row), 4096):
                rows = row[start : start + 4096]
                yield batch_of(schema, name[start : start + 4096], node[rows], copies[rows], list(unit[rows]), [own[r] for r in rows])

    return run


class _Chains:
    """Union-find over the places of one pair of slices."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)


def _compare(min_cosine: float):
    """All pairs of two slices of one filter (or within one slice): links per node, and chains."""

    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        name, a, b = key
        pdf = pdf.sort_values(["slice", "node"], kind="stable").reset_index(drop=True)
        vectors = np.stack(pdf["vector"].to_numpy())
        split = int((pdf["slice"] == a).sum()) if a != b else 0
        left, right = (np.arange(split), np.arange(split, len(pdf))) if a != b else (np.arange(len(pdf)),) * 2
        cosines = vectors[left] @ vectors[right].T
        i, j = np.nonzero(cosines >= min_cosine)
        i, j = left[i], right[j]
        if a == b:
            i, j = i[i < j], j[i < j]
        if len(i):
            # A pair of several common filters counts in the lowest one.
            own = [np.asarray(f) for f in pdf["filters"]]
            lower = {k: set(own[k][own[k] < name].tolist()) for k in set(i.tolist()) | set(j.tolist())}
            counted = np.fromiter((lower[x].isdisjoint(lower[y]) for x, y in zip(i.tolist(), j.tolist())), dtype=bool, count=len(i))
            i, j = i[counted], j[counted]
        copies, node = pdf["copies"].to_numpy(), pdf["node"].to_numpy()
        links = np.bincount(i, weights=copies[j], minlength=len(pdf)) + np.bincount(j, weights=copies[i], minlength=len(pdf))
        chains = _Chains(len(pdf))
        for x, y in zip(i.tolist(), j.tolist()):
            chains.join(x, y)
        some = np.flatnonzero(links)
        roots = [node[chains.root(k)] for k in some.tolist()]
        return pd.DataFrame({"node": node[some], "links": links[some].astype("int64"), "chain": np.array(roots, dtype="int64")})

    return run


def vector_links(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", min_cosine: float = MIN_COSINE, **code_options
) -> DataFrame:
    """``(id, n_links, component_id)`` of every row: how many other vectors are linked with it directly,
    and the smallest id that links reach from it."""
    work_root(vectors.sparkSession)
    rows = _node_rows(vectors, id_col, vector_col)
    nodes = (
        rows.where(F.col("vector").isNotNull())
        .groupBy("vector")
        .agg(F.min("id").alias("first"), F.count("*").alias("copies"))
        .withColumn("node", F.monotonically_increasing_id())
        .checkpoint()
    )
    sizes = nodes.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy("n").collect()
    members = rows.join(nodes, "vector").select("id", "node", "copies", "first")
    none = rows.where(F.col("vector").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if not sizes:
        return none
    shared = vectors.sparkSession.sparkContext.broadcast([(size.n, Codes(size.n, size.rows, min_cosine, **code_options)) for size in sizes])
    decoded = nodes.select("node", "copies", "vector").mapInArrow(
        _decode(shared), "filter long, node long, copies long, vector array<double>, filters array<long>"
    )

    members_of = decoded.groupBy("filter").agg(F.count("*").alias("members")).where("members > 1")
    slices = F.ceil(F.col("members") / SLICE).cast("int")
    sliced = decoded.join(members_of, "filter").select(
        "filter", "node", "copies", "vector", "filters", slices.alias("slices"), F.pmod(F.xxhash64("node"), slices).cast("int").alias("slice")
    )
    # A row goes to every pair of slices that has its own: once per slice of its filter.
    others = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda s: F.struct(F.least("slice", s).alias("a"), F.greatest("slice", s).alias("b")))
    paired = sliced.select("filter", "node", "copies", "vector", "filters", "slice", F.explode(others).alias("pair"))
    found = (
        paired.select("filter", "pair.a", "pair.b", "node", "copies", "vector", "filters", "slice")
        .groupBy("filter", "a", "b")
        .applyInPandas(_compare(min_cosine), "node long, links long, chain long")
        .checkpoint()
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.where("node <> chain").select(F.col("node").alias("src"), F.col("chain").alias("dst"))
    chained = connected_components(edges).select("node", F.col("component"))
    grouped = (
        members.join(chained, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .join(links, "node", "left")
    )
    smallest = grouped.groupBy("component").agg(F.min("id").alias("component_id"))
    linked = grouped.join(smallest, "component").select(
        "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id"
    )
    return linked.unionByName(none)
