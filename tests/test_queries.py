"""Every registered query against its SQL twin, and the shape of the plans."""

import pytest
from check_oracle import differences, duck

import __spark_entry__ as driver
from corpuslens.plans import ORACLES, Tables, load_queries

FOLDER = "/root/testdata/sf0.001"
QUERIES = load_queries()


@pytest.fixture(scope="module")
def duckdb_tables():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duckdb_tables, name):
    df = driver.queries()[name](spark, FOLDER)
    if name in ORACLES:
        assert differences(df, duckdb_tables, ORACLES[name]) is None
    else:
        assert len(df.collect()) == df.count()


def test_entry(spark):
    assert driver.entry(spark).columns == ["md5", "copies", "owners", "first_id"]
    assert set(driver.oracle_sql()) <= set(driver.queries())


# Queries that run jobs or streams of their own before they return.
EAGER = {
    "similar_components", "similarity_groups", "similarity_edges", "similarity_members", "digest_scores", "candidate_links",
    "candidate_union", "adjacency", "log_window_stream", "scan_progress", "stream_import", "scan_fanout", "scan_progress_bounded",
    "link_groups", "incremental_links", "passage_patterns", "secret_table_scan", "pattern_table_classify", "rollup_totals",
    "rollup_estimates", *(name for name in QUERIES if name.startswith(("store_", "indexed_"))),
}


def test_no_plan_pairs_everything_with_everything(spark):
    """Without broadcasts a join without an equality would show as a Cartesian product."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in sorted(set(QUERIES) - EAGER):
            plan = QUERIES[name](Tables(spark, FOLDER))._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
