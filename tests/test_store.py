"""Stored tables: what a change rewrites, what a dead run leaves, pages in both directions; the hash index."""

import itertools
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from corpuslens import store as st
from corpuslens.operators.hash_index import HashIndex


def table_of(spark, ids, note="old"):
    return spark.createDataFrame([(i, f"name{i}", note) for i in ids], "id long, name string, note string")


@pytest.fixture
def made(spark, tmp_path):
    store = st.Store(spark, str(tmp_path / "store"))
    store.create("files", table_of(spark, range(0, 2000, 2)), "id", bucket_rows=10)
    return store


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_change_rewrites_the_buckets_it_touches(spark, made):
    before = {b.path for b in made.tables()["files"].buckets}
    assert 90 <= len(before) <= 130
    change = made.upsert("files", spark.createDataFrame([(i, "new") for i in range(500, 520)], "id long, note string"))
    after = {b.path for b in made.tables()["files"].buckets}
    assert change.rewritten <= 4 and len(after - before) <= 4
    got = {r.id: (r.name, r.note) for r in made.table("files").collect()}
    want = {i: (f"name{i}", "old") for i in range(0, 2000, 2)}
    want |= {i: (f"name{i}" if i % 2 == 0 else None, "new") for i in range(500, 520)}
    assert got == want
    # The version before is still there as it was.
    assert {r.note for r in made.table("files", version=1).collect()} == {"old"} and made.versions() == [1, 2]


def test_random_changes_equal_a_dictionary(spark, made):
    rng = random.Random(4)
    want = {i: "old" for i in range(0, 2000, 2)}
    for step in range(4):
        ids = rng.sample(range(-50, 2600), 40 + 60 * step)
        made.upsert("files", spark.createDataFrame([(i, f"s{step}") for i in ids], "id long, note string"))
        want |= {i: f"s{step}" for i in ids}
        gone = rng.sample(sorted(want), 30)
        made.delete("files", spark.createDataFrame([(i,) for i in gone], "gone long"))
        want = {i: n for i, n in want.items() if i not in gone}
        assert {r.id: r.note for r in made.table("files").collect()} == want
    buckets = made.tables()["files"].buckets
    firsts = [b.first for b in buckets]
    assert firsts[0] is None and firsts[1:] == sorted(firsts[1:]) and max(b.rows for b in buckets) <= 25
    made.delete("files", spark.createDataFrame([(i,) for i in want], "gone long"))
    assert made.table("files").collect() == []
    made.upsert("files", table_of(spark, [5, 3]))
    assert rows_of(made.table("files").select("id")) == [(3,), (5,)]


def test_a_run_that_dies_leaves_the_version_before(spark, made, monkeypatch):
    whole = rows_of(made.table("files"))

    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(made, "_commit", die)
        with pytest.raises(RuntimeError, match="killed"):
            made.upsert("files", table_of(spark, [1, 3, 5], "lost"))
    broken = table_of(spark, [7]).withColumn("note", F.raise_error(F.lit("task died")))
    with pytest.raises(Exception, match="task died"):
        made.upsert("files", broken)
    assert made.version() == 1 and rows_of(made.table("files")) == whole
    made.upsert("files", table_of(spark, [1]))
    assert made.vacuum(keep=1) > 0 and made.versions() == [2]
    assert len(made.table("files").collect()) == 1001
    assert made.vacuum(keep=1) == 0


def test_one_of_two_writers_is_refused(spark, made, monkeypatch):
    other = st.Store(spark, made.root)
    rewritten = made._rewritten

    def overtaken(*args):
        change = rewritten(*args)
        other.upsert("files", table_of(spark, [9], "other"))
        return change

    monkeypatch.setattr(made, "_rewritten", overtaken)
    with pytest.raises(st.Conflict):
        made.upsert("files", table_of(spark, [11], "mine"))
    assert {r.id for r in made.table("files").where("id IN (9, 11)").collect()} == {9}


def test_cascades_are_one_version(spark, tmp_path):
    store = st.Store(spark, str(tmp_path / "store"))
    pairs = lambda names, rows: spark.createDataFrame(rows, f"{names[0]} string, {names[1]} string")
    store.create("firmware", pairs(("id", "x"), [("f1", "x"), ("f2", "x"), ("é", "x")]), "id", 1)
    store.create("file", pairs(("id", "firmware"), [(f"p{i}", f"f{i % 3}") for i in range(30)]), "id", 5)
    store.create("report", pairs(("id", "file"), [(f"r{i}", f"p{i}") for i in range(0, 30, 2)] + [("r98", None)]), "id", 5)
    store.create("other", pairs(("id", "y"), [("o", "f1")]), "id", 5)
    cascades = {"firmware": {"file": "firmware", "absent": "firmware"}, "file": {"report": "file"}}
    changes = store.delete("firmware", spark.createDataFrame([("f1",), ("nope",)], "id string"), cascades)
    assert set(changes) == {"firmware", "file", "report"} and store.version() == 5
    assert rows_of(store.table("firmware").select("id")) == [("f2",), ("é",)]
    assert {r.firmware for r in store.table("file").collect()} == {"f0", "f2"}
    assert {r.id for r in store.table("report").collect()} == {f"r{i}" for i in range(0, 30, 2) if i % 3 != 1} | {"r98"}
    nothing = store.delete("firmware", spark.createDataFrame([("f9",)], "id string"), cascades)
    assert all(change.rewritten == 0 for change in nothing.values())


def test_quarantine(spark, made):
    rows = table_of(spark, [1, 3, 4], "new")
    made.admit("files", rows, {"three": F.col("id") == 3, "odd": F.col("id") % 2 == 1})
    assert rows_of(made.table("quarantine").select("id", "reason")) == [(1, "odd"), (3, "three")]
    assert rows_of(made.table("files").where("note = 'new'").select("id")) == [(4,)]
    made.admit("files", rows, {"three": F.col("id") == 3})
    assert rows_of(made.table("quarantine").select("id", "reason")) == [(3, "three")]
    assert rows_of(made.table("files").where("note = 'new'").select("id")) == [(1,), (4,)]


def test_ids_are_checked(spark, made):
    with pytest.raises(Exception, match="an id is null"):
        made.upsert("files", table_of(spark, [1]).withColumn("id", F.lit(None).cast("long")))
    with pytest.raises(Exception, match="an id is null"):
        made.create("more", spark.createDataFrame([(None, "a")], "id long, x string"), "id")
    with pytest.raises(ValueError, match="cannot be cut"):
        made.create("more", spark.createDataFrame([(1.5,)], "id double"), "id")
    assert made.version() == 1


def test_pages_in_both_directions(made):
    ids, size = list(range(0, 2000, 2)), 7
    walked, cursor = [], None
    for _ in itertools.count():
        page = made.page("files", first=size, after=cursor)
        got = page.rows.collect()
        walked += [r.id for r in got]
        assert page.has_previous == (cursor is not None) and len(page.buckets_read) <= 4
        if len(walked) > 60:
            break
        cursor = got[-1].cursor
    assert walked == ids[: len(walked)] and page.has_next
    back = made.page("files", last=size, before=st.cursor_of(1000))
    assert [r.id for r in back.rows.collect()] == list(range(986, 1000, 2)) and back.has_previous and back.has_next
    end = made.page("files", last=3)
    assert [r.id for r in end.rows.collect()] == [1994, 1996, 1998] and not end.has_next and end.has_previous
    assert [r.id for r in made.page("files", first=9, after=st.cursor_of(1990)).rows.collect()] == [1992, 1994, 1996, 1998]
    assert made.page("files", first=5, after=st.cursor_of(5000)).rows.collect() == []
    rare = made.page("files", first=2, filters={"name": "name1500"})
    assert [r.id for r in rare.rows.collect()] == [1500] and not rare.has_next


def test_a_page_reads_the_same_from_a_larger_table(spark, made, tmp_path):
    larger = st.Store(spark, str(tmp_path / "larger"))
    larger.create("files", table_of(spark, range(0, 20000, 2)), "id", bucket_rows=10)

    def read(store):
        page = store.page("files", first=5, after=st.cursor_of(700))
        return sum(os.path.getsize(f.path) for b in page.buckets_read for f in os.scandir(f"{store._top}/data/{b}"))

    assert read(larger) <= 2 * read(made)


def test_pages_are_asked_for_properly(made):
    for wrong in ({}, {"first": 1, "last": 1}, {"first": 1, "before": "x"}, {"last": 1, "after": "x"}, {"first": -1}):
        with pytest.raises(ValueError):
            made.page("files", **wrong)
    for cursor in ("%%%", "bnVsbA==", "dHJ1ZQ=="):
        with pytest.raises(ValueError, match="cursor"):
            made.page("files", first=1, after=cursor)
    assert made.page("files", first=0).rows.collect() == []


def exchanges(df):
    # After a run the plan is printed twice, as it was and as it was first meant.
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    return len(re.findall(r"Exchange hashpartitioning", plan)), plan


def test_the_index_side_is_not_exchanged(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias("file_id"), F.md5((F.col("id") % 1000).cast("string")).alias("md5"))
    index = HashIndex(spark, str(tmp_path / "index"), "hash_index_test", "md5", buckets=8)
    index.add(rows.where("file_id < 2500"))
    wanted = rows.where("file_id IN (2600, 7, 8)").select("md5", F.col("file_id").alias("app_id"))
    found = index.all_matches(wanted)
    assert sorted(r.file_id for r in found.collect()) == sorted(i for i in range(2500) if i % 1000 in (600, 7, 8))
    first = index.first_match(wanted, "file_id")
    assert sorted((r.app_id, r.file_id) for r in first.collect()) == [(7, 7), (8, 8), (2600, 600)]
    known = [(3, r.md5) for r in wanted.collect()]
    new = index.new(spark.createDataFrame([(1, "none"), (2, "none"), *known], "k int, md5 string"))
    assert sorted(r.k for r in new.collect()) == [1, 2]
    duplicates = index.duplicates("file_id")
    assert duplicates.count() == 1000
    # Only the other side comes to the index: nothing between the scan of the index and its join or grouping.
    for result, others in ((found, 2), (first, 1), (new, 1), (duplicates, 0)):
        n, plan = exchanges(result)
        assert n <= others and "Bucketed: true" in plan, plan
    index.add(rows.where("file_id >= 2500"))
    assert index.all_matches(wanted).count() == 9
    spark.sql("DROP TABLE hash_index_test")
    again = HashIndex(spark, str(tmp_path / "index"), "hash_index_test", "md5", buckets=8).open("file_id long, md5 string")
    assert again.duplicates("file_id").count() == 1000 and exchanges(again.duplicates("file_id"))[0] == 0
