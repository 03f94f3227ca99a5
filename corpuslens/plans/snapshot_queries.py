"""Snapshots: upsert, cascade, re-import."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import snapshots as sn
from ..operators.numbering import chunked
from .registry import Tables, query


@query(
    "upsert_snapshot",
    """
    WITH cur AS (SELECT o_custkey AS job_id, count(*) AS n, max(o_orderpriority) AS arch FROM orders GROUP BY 1),
    chg AS (SELECT c_custkey AS job_id, CASE WHEN c_nationkey < 5 THEN 0 END AS n, c_mktsegment AS arch FROM customer WHERE c_nationkey < 10)
    SELECT coalesce(cur.job_id, chg.job_id) AS job_id, coalesce(chg.n, cur.n) AS n, coalesce(chg.arch, cur.arch) AS arch
    FROM cur FULL JOIN chg ON cur.job_id = chg.job_id
    """,
)
def upsert_snapshot(t: Tables) -> DataFrame:
    current = t.orders.groupBy(F.col("o_custkey").alias("job_id")).agg(
        F.count("*").alias("n"), F.max("o_orderpriority").alias("arch")
    )
    changes = t.customer.where("c_nationkey < 10").select(
        F.col("c_custkey").alias("job_id"),
        F.when(F.col("c_nationkey") < 5, F.lit(0).cast("long")).alias("n"),
        F.col("c_mktsegment").alias("arch"),
    )
    return sn.upsert(current, changes, ["job_id"])


@query(
    "cascade_delete",
    """
    WITH gone AS (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING')
    SELECT 'customer' AS kept_in, count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING'
    UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM gone)
    UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone)
    """,
)
def cascade_delete(t: Tables) -> DataFrame:
    """Three levels: customers, their orders, the lines of these."""
    tables = {
        "customer": t.customer.select("c_custkey"),
        "orders": t.orders.select("o_orderkey", "o_custkey"),
        "lineitem": t.lineitem.select("l_orderkey"),
    }
    gone = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    cascades = {"customer": {"orders": "o_custkey"}, "orders": {"lineitem": "l_orderkey"}}
    kept = sn.delete_cascade(tables, "customer", gone, {"customer": "c_custkey", "orders": "o_orderkey"}, cascades)
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kept_in"), "n") for name, df in kept.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "delete_batches",
    """
    SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 100)::BIGINT AS batch_no FROM orders WHERE o_orderstatus = 'P'
    """,
)
def delete_batches(t: Tables) -> DataFrame:
    return chunked(t.orders.where("o_orderstatus = 'P'").select("o_orderkey"), "o_orderkey", 100, "batch_no")


@query(
    "reimport_plan",
    """
    SELECT c_custkey, CASE WHEN c_nationkey = 4 THEN 'import' ELSE 'keep' END AS action,
           CASE WHEN c_nationkey = 4 THEN c_mktsegment END AS store_uuid FROM customer
    """,
)
def reimport_plan(t: Tables) -> DataFrame:
    path = F.concat(F.lit("/mnt/data/corpus/stores/"), F.col("c_mktsegment"), F.lit("/"), F.col("c_custkey"))
    firmware = t.customer.select("c_custkey", path.alias("path"))
    stores = t.customer.select(F.col("c_mktsegment").alias("store_uuid")).distinct()
    chosen = t.customer.where("c_nationkey = 4").select("c_custkey")
    feed, rest = sn.reimport_plan(firmware, stores, chosen, "c_custkey", "path")
    return feed.select("c_custkey", F.lit("import").alias("action"), "store_uuid").unionByName(
        rest.select("c_custkey", F.lit("keep").alias("action"), F.lit(None).cast("string").alias("store_uuid"))
    )
