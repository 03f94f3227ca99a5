"""Merged statistics against exact ones."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import rollups as ru


def values_of(rng, n):
    kinds = [lambda: rng.uniform(-5, 5), lambda: rng.lognormvariate(3, 4), lambda: 0.0, lambda: -rng.expovariate(1e-9), lambda: float(rng.randint(1, 9))]
    return [rng.choice(kinds)() for _ in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [(f"f{i % 3}", f"2024-01-0{1 + i % 4}", v, f"pkg{int(abs(v) * 7) % 900}") for i, v in enumerate(values_of(rng, 4000))]
    data += [("f0", "2024-01-01", None, None), ("f1", None, float("inf"), "x"), ("f2", "2024-01-02", float("nan"), "y")]
    return data, spark.createDataFrame(data, "owner_id string, day_text string, v double, pkg string")


def stored(spark, path, rows, order):
    rollups = ru.Rollups(spark, str(path), numeric=["v"], distinct=["pkg"])
    for owners in order:
        rollups.add(rows.where(F.col("owner_id").isin(owners)), "owner_id", "day_text")
    return rollups


def quantile(values, share):
    return sorted(values)[math.ceil(len(values) * share) - 1]


def test_merged_equals_exact(spark, rows, tmp_path):
    data, df = rows
    rollups = stored(spark, tmp_path, df, [["f0"], ["f1", "f2"], ["f0"]])  # one owner twice
    finite = [v for _, _, v, _ in data if v is not None and math.isfinite(v)]
    shares = (0.01, 0.25, 0.5, 0.75, 0.9, 1.0)
    for row in rollups.quantiles(shares).collect():
        exact = quantile(finite, row.share)
        assert abs(row.value - exact) <= abs(exact) * ru.ACCURACY * 1.0001, row
    by_owner = {(r.owner, r.share): r.value for r in rollups.quantiles([0.5], by=["owner"]).collect()}
    for owner in ("f0", "f1", "f2"):
        exact = quantile([v for o, _, v, _ in data if o == owner and v is not None and math.isfinite(v)], 0.5)
        assert abs(by_owner[owner, 0.5] - exact) <= abs(exact) * ru.ACCURACY * 1.0001
    found = rollups.distinct_counts().first()
    exact = len({p for *_, p in data if p is not None})
    assert abs(found.distinct_values - exact) <= 0.05 * exact
    total = rollups.totals(by=["day"]).where("day = DATE'2024-01-03'").first()
    own = [v for _, d, v, _ in data if d == "2024-01-03" and v is not None]
    assert total.n == len(own) and total.lowest == min(own) and total.highest == max(own)
    assert total.total == pytest.approx(sum(own)) and total.mean == pytest.approx(sum(own) / len(own))
    histogram = rollups.histogram().agg(F.sum("n")).first()[0]
    assert histogram == len(finite)


def test_adding_an_owner_leaves_the_others_alone(spark, rows, tmp_path):
    _, df = rows
    stored(spark, tmp_path, df, [["f0", "f1"]])
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "totals").glob("owner=f[01]/*.parquet")}
    rollups = stored(spark, tmp_path, df, [["f2"]])
    assert {f: f.stat().st_mtime_ns for f in (tmp_path / "totals").glob("owner=f[01]/*.parquet")} == before
    assert {r.owner for r in rollups.totals(by=["owner"]).collect()} == {"f0", "f1", "f2"}


def test_buckets_rise_with_the_value(spark):
    values = [-1e300, -2.0, -1e-300, 0.0, 1e-300, 0.5, 0.50001, 1.0, 2.0, 1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).withColumn("b", ru.log_bucket(F.col("v")))
    found = df.withColumn("back", ru.bucket_value(F.col("b"))).collect()
    assert [r.b for r in found] == sorted(r.b for r in found)
    assert all(abs(r.back - r.v) <= abs(r.v) * ru.ACCURACY * 1.0001 for r in found)


def test_nothing_stored_for_an_empty_import(spark, rows, tmp_path):
    _, df = rows
    rollups = stored(spark, tmp_path, df, [["f0"], ["none"]])
    assert {r.owner for r in rollups.totals(by=["owner"]).collect()} == {"f0"}
