"""Packed pairs of numbers, and links made of them."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import packed
from corpuslens.operators import similarity as sim

ENDS = [-(2**63), -1, 0, 2**63 - 1]


def test_packed_columns_come_back():
    rng = np.random.default_rng(3)
    for first, second in ((ENDS, ENDS[::-1]), ([5], [-7]), (rng.integers(0, 2**42, 500), rng.integers(0, 40, 500)), ([3, 3, 3], [1, 1, 0])):
        first, second = np.array(first, np.int64), np.array(second, np.int64)
        got = packed.unpack(packed.pack(first, second))
        assert sorted(zip(*(c.tolist() for c in got))) == sorted(set(zip(first.tolist(), second.tolist())))
    assert len(packed.pack(np.arange(0, 10**9, 10**4), np.arange(10**5) % 50)) < 4 * 10**5


@pytest.mark.parametrize("rows", [3, 1000])
def test_packed_links(spark, monkeypatch, rows):
    """Numbers of all kinds, nulls and rows that come again, packed a few at a time."""
    rng = random.Random(rows)
    held = [(rng.choice([*ENDS, *range(60)]), rng.choice([*ENDS, *range(30)])) for _ in range(400)]
    lowest = {}
    for node, key in held:
        lowest[key] = min(node, lowest.get(key, node))
    monkeypatch.setattr(packed, "PACKED_ROWS", rows)
    df = spark.createDataFrame([*held, *held[:50], (None, 1), (3, None)], "node long, key long").repartition(3)
    found = [tuple(r) for r in sim.candidate_links(df).collect()]
    assert sorted(found) == sorted({(lowest[k], n) for n, k in held if n > lowest[k]})
    words = sim.candidate_links(df.na.drop().select(F.concat(F.lit("n"), "node").alias("node"), "key")).collect()
    assert len(words) > 100 and all(r.src < r.dst for r in words)


def test_links_take_little_of_a_shuffle(spark):
    """Postings go packed, not as rows of two numbers."""
    links = sim.candidate_links(spark.range(100).select(F.col("id").alias("node"), (F.col("id") % 7).alias("key")))
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(part", plan)) == 2


@pytest.mark.parametrize("rows", [2, 1000])
def test_a_forest_reaches_as_far_as_the_links(rows):
    rng = random.Random(rows)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(n + 1, n) for n in range(400, 460)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links[at : at + 7])], names=["high", "low"]) for at in range(0, len(links), 7)]
    (high, low), = packed.forest(iter(batches), rows)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert dict(zip(high.tolist(), low.tolist())) == {n: root(n) for n in list(parent) if n != root(n)} and len(high) == len(set(high.tolist()))
