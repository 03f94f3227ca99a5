"""Rules over large call tables: what is shuffled, and results on odd input."""

import pytest
from pyspark.sql import functions as F

from corpuslens import session
from corpuslens.operators import rules as rl


def catalogue(spark, rows):
    data = [(crime, [], [{"class": c, "method": m, "descriptor": "()V"} for c, m in api], score, []) for crime, api, score in rows]
    return spark.createDataFrame(data, rl.RULE_SCHEMA)


CALLS = "app_id long, caller string, seq long, callee_class string, callee_method string, descriptor string"


def test_calls_do_not_multiply_by_rules_before_a_shuffle(spark):
    """Every ordered pair of 30 methods is a rule; a call belongs to 58 of them."""
    names = [f"m{i}" for i in range(30)]
    rules = catalogue(spark, [(f"{a}-{b}", [("P", a), ("P", b)], 1.0) for a in names for b in names if a != b])
    calls = spark.range(6000).select(
        (F.col("id") % 7).alias("app_id"), F.concat(F.lit("c"), F.floor(F.col("id") / 3)).alias("caller"), F.col("id").alias("seq"),
        F.lit("P").alias("callee_class"), F.concat(F.lit("m"), F.col("id") % 30).alias("callee_method"), F.lit("()V").alias("descriptor"),
    )
    found = rl.behaviours(calls, rules)
    rows = found.collect()
    # Exchanges of the executed plan carry at most a row per call.
    plan, sizes = found._jdf.queryExecution().executedPlan().toString(), []
    assert "BroadcastHashJoin" in plan
    stages = found._jdf.queryExecution().executedPlan().executedPlan()
    todo = [stages]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            sizes.append(node.metrics().apply("shuffleRecordsWritten").value())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert sizes and max(sizes) <= 6000
    by_caller = {}
    for r in calls.collect():
        by_caller.setdefault((r.app_id, r.caller), []).append((r.callee_method, r.seq))
    want = {(f"{a}-{b}", app, c, x, y, x < y) for (app, c), made in by_caller.items() for a, x in made for b, y in made if a != b}
    assert {(r.crime, r.app_id, r.caller, r.first_seq, r.second_seq, r.in_order) for r in rows} == want and len(rows) == len(want)


def test_odd_rules_and_calls(spark):
    rules = catalogue(spark, [
        ("same call twice", [("P", "a"), ("P", "a")], 1.0), ("null class", [(None, "a"), ("P", "b")], 1.0), ("one call", [("P", "a")], 1.0),
        ("several", [("P", "a"), ("P", "b")], 2.0), ("several", [("P", "c"), ("P", "d")], 3.0),
    ])
    calls = spark.createDataFrame([
        (1, "x", 5, "P", "a", "()V"), (1, "x", 2, "P", "b", "()V"), (1, "x", 9, "P", "b", "()V"), (1, "x", 1, "P", "c", "()V"),
        (1, "y", None, "P", "a", "()V"), (1, "y", 3, "P", "b", "()V"), (None, None, 4, "P", "c", "()V"), (None, None, 6, "P", "d", "()V"),
        (2, "x", 5, "P", "b", "()V"), (2, "x", 6, None, "a", "()V"),
    ], CALLS)
    found = {(r.crime, r.app_id, r.caller, r.first_seq, r.second_seq) for r in rl.behaviours(calls, rules).collect()}
    assert found == {("same call twice", 1, "x", 5, 5), ("several", 1, "x", 1, 9), ("several", None, None, 4, 6)}


def test_classes_nobody_asks_for_are_not_followed(spark):
    """A hundred classes of an app in one chain; a handler is in the third one from the top."""
    proceed, override = rl.Call("H", "proceed", "()V"), rl.Call("Base", "onError", "(X)V")
    chain = [(app, f"k{i}", f"k{i + 1}" if i < 100 else "Base") for app in (1, 2) for i in range(101)] + [(3, "k98", "k97"), (3, "k97", "k98")]
    hierarchy = spark.createDataFrame(chain, "app_id long, name string, extends string")
    calls = spark.createDataFrame(
        [(app, "k98", "onError", "(X) V", "H", "proceed", "() V") for app in (1, 1, 3, 4)] + [(2, "k98", "other", "(X)V", "H", "proceed", "()V")],
        "app_id long, caller_class string, caller_method string, caller_descriptor string, callee_class string, callee_method string, descriptor string",
    )
    seen = []
    original = rl.ancestors

    def counted(*args, **kwargs):
        seen.append(original(*args, **kwargs))
        return seen[-1]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(rl, "ancestors", counted)
        found = rl.overridden_certificate_checks(calls, hierarchy, proceed, override).collect()
    assert [tuple(r) for r in found] == [("CWE295", 1, "k98->onError")]
    assert seen[0].count() <= 6


def test_calls_of_larger_tables_come_in_more_pieces(spark, tmp_path):
    """The rows of a task stay as they are when the table grows."""
    held = []
    for n in (200_000, 800_000):
        lines = spark.range(n).select(
            F.col("id").alias("l_orderkey"), (F.col("id") % 100).alias("l_partkey"), F.lit(1).cast("long").alias("l_linenumber"), F.rand(1).alias("l_quantity"), F.lit("R").alias("l_returnflag")
        )
        lines.write.parquet(str(tmp_path / f"{n}"))
        pieces = session.dealt(spark.read.parquet(str(tmp_path / f"{n}")), "l_orderkey", piece=100_000)
        held.append(max(r["count"] for r in pieces.groupBy(F.spark_partition_id()).count().collect()))
    assert held[1] < 1.3 * held[0] < 200_000 / 8
