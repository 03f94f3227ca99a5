"""Stored tables: committed changes, pages, and the index of content hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.hash_index import HashIndex
from ..session import new_work_dir
from ..store import Store, cursor_of
from .inventory_queries import files
from .registry import Tables, query

CASCADES = {"customer": {"orders": "o_custkey"}, "orders": {"lineitem": "l_orderkey"}}


def _store(t: Tables) -> Store:
    return Store(t.spark, new_work_dir(t.spark, "store"))


def _customers(t: Tables) -> Store:
    store = _store(t)
    store.create("customer", t.customer, "c_custkey", bucket_rows=200)
    return store


@query(
    "store_upsert",
    """
    WITH chg AS (SELECT o_custkey AS k, max(o_orderpriority) AS segment, CASE WHEN count(*) > 12 THEN 0.5 END AS balance
                 FROM orders WHERE o_orderkey < 4000 GROUP BY 1
                 UNION ALL SELECT s_suppkey + 100000000, 'SUPPLIER', s_acctbal FROM supplier)
    SELECT coalesce(c_custkey, k) AS c_custkey, c_name, c_nationkey, coalesce(balance, c_acctbal)::DOUBLE AS c_acctbal, coalesce(segment, c_mktsegment) AS c_mktsegment
    FROM customer FULL JOIN chg ON c_custkey = k
    """,
)
def store_upsert(t: Tables) -> DataFrame:
    """Customers after two committed changes: some rows are changed in part, some are new."""
    store = _customers(t)
    changed = t.orders.where("o_orderkey < 4000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_orderpriority").alias("c_mktsegment"), F.when(F.count("*") > 12, F.lit(0.5)).alias("c_acctbal")
    )
    store.upsert("customer", changed)
    store.upsert("customer", t.supplier.select((F.col("s_suppkey") + 100000000).alias("c_custkey"), F.lit("SUPPLIER").alias("c_mktsegment"), F.col("s_acctbal").alias("c_acctbal")))
    return store.table("customer")


@query(
    "store_cascade",
    """
    WITH gone AS (SELECT c_custkey FROM customer WHERE c_nationkey = 7),
    kept AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone))
    SELECT 'customer' AS name, c_custkey AS id, NULL::INTEGER AS line FROM customer WHERE c_nationkey <> 7
    UNION ALL SELECT 'orders', o_orderkey, NULL FROM kept
    UNION ALL SELECT 'lineitem', l_orderkey, l_linenumber FROM lineitem
      WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone))
    """,
)
def store_cascade(t: Tables) -> DataFrame:
    """Customers of a nation go with their orders and the lines of these, in one version of three tables."""
    store = _customers(t)
    store.create("orders", t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", bucket_rows=2_000)
    line = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_id")
    store.create("lineitem", t.lineitem.select(line, "l_orderkey", "l_linenumber"), "line_id", bucket_rows=8_000)
    store.delete("customer", t.customer.where("c_nationkey = 7").select("c_custkey"), CASCADES)
    nothing = F.lit(None).cast("int").alias("line")
    return (
        store.table("customer").select(F.lit("customer").alias("name"), F.col("c_custkey").alias("id"), nothing)
        .unionByName(store.table("orders").select(F.lit("orders").alias("name"), F.col("o_orderkey").alias("id"), nothing))
        .unionByName(store.table("lineitem").select(F.lit("lineitem").alias("name"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line")))
    )


@query(
    "store_quarantine",
    """
    SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 1 THEN 'pending' WHEN o_totalprice > 400000 THEN 'price' END AS reason FROM orders
    """,
)
def store_quarantine(t: Tables) -> DataFrame:
    """Orders that come in, and those put aside with the reason; a second try admits half of the pending ones."""
    store = _store(t)
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    store.create("orders", rows.limit(0), "o_orderkey", bucket_rows=4_000)
    price = F.col("o_totalprice") > 400000
    store.admit("orders", rows, {"pending": F.col("o_orderstatus") == "P", "price": price})
    again = store.table("quarantine").where("reason = 'pending' AND o_orderkey % 2 = 0").drop("reason")
    store.admit("orders", again, {"price": price})
    admitted = store.table("orders").select("o_orderkey", "o_totalprice", F.lit(None).cast("string").alias("reason"))
    return admitted.unionByName(store.table("quarantine").select("o_orderkey", "o_totalprice", "reason"))


@query(
    "store_reimport",
    """
    SELECT c_custkey AS id, 'import' AS action, c_mktsegment AS store FROM customer WHERE c_nationkey = 4
    UNION ALL SELECT o_orderkey, 'keep', NULL FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 4)
    """,
)
def store_reimport(t: Tables) -> DataFrame:
    """Customers that are fed to the importer again, with their store, and the orders that do not go with them."""
    store = _store(t)
    path = F.concat(F.lit("/mnt/data/corpus/stores/"), F.col("c_mktsegment"), F.lit("/"), F.col("c_custkey"))
    store.create("customer", t.customer.select("c_custkey", path.alias("path")), "c_custkey", bucket_rows=200)
    store.create("orders", t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", bucket_rows=4_000)
    stores = t.customer.select(F.col("c_mktsegment").alias("store_uuid")).distinct()
    feed = store.reimport("customer", t.customer.where("c_nationkey = 4").select("c_custkey"), stores, "path", CASCADES)
    kept = store.table("orders").select(F.col("o_orderkey").alias("id"), F.lit("keep").alias("action"), F.lit(None).cast("string").alias("store"))
    return feed.select(F.col("c_custkey").alias("id"), F.lit("import").alias("action"), F.col("store_uuid").alias("store")).unionByName(kept)


PAGE = 25


def _page_sql(name: str, condition: str, order: str) -> str:
    return f"SELECT '{name}' AS page, c_custkey, c_name FROM (SELECT * FROM customer WHERE {condition} ORDER BY c_custkey {order} LIMIT {PAGE}) {name}"


@query(
    "store_pages",
    " UNION ALL ".join(
        [
            _page_sql("first", "true", ""), _page_sql("next", "c_custkey > 60", ""), _page_sql("last", "true", "DESC"),
            _page_sql("previous", "c_custkey < 130", "DESC"), _page_sql("filtered", "c_custkey > 10 AND c_nationkey = 3", ""),
        ]
    ),
)
def store_pages(t: Tables) -> DataFrame:
    """Pages of a stored table in both directions, by cursor, one of them of filtered rows."""
    store = _customers(t)
    pages = {
        "first": store.page("customer", first=PAGE), "next": store.page("customer", first=PAGE, after=cursor_of(60)),
        "last": store.page("customer", last=PAGE), "previous": store.page("customer", last=PAGE, before=cursor_of(130)),
        "filtered": store.page("customer", first=PAGE, after=cursor_of(10), filters={"c_nationkey": 3}),
    }
    found = [page.rows.select(F.lit(name).alias("page"), "c_custkey", "c_name") for name, page in pages.items()]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows


def _index(t: Tables, rows: DataFrame) -> HashIndex:
    index = HashIndex(t.spark, new_work_dir(t.spark, "hashes"), f"hashes_{uuid.uuid4().hex}", "md5", buckets=16)
    index.add(rows)
    return index


@query(
    "indexed_matches",
    """
    SELECT doc_id AS file_id, md5(text) AS md5 FROM documents
    WHERE md5(text) IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
    """,
)
def indexed_matches(t: Tables) -> DataFrame:
    rows = files(t).select("file_id", "md5")
    toxic = t.labels.where("toxic = 1").select(F.col("doc_id").alias("file_id"))
    return _index(t, rows).all_matches(rows.join(toxic, "file_id", "left_semi")).select("file_id", "md5")


@query(
    "indexed_first_match",
    """
    WITH f AS (SELECT md5(text) AS md5, min(doc_id) AS file_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1)
    SELECT doc_id AS app_id, f.file_id FROM documents a LEFT JOIN f ON md5(a.text) = f.md5 WHERE doc_id IN (SELECT doc_id FROM labels)
    """,
)
def indexed_first_match(t: Tables) -> DataFrame:
    rows = files(t).select("file_id", "md5")
    known = t.labels.select(F.col("doc_id").alias("file_id"))
    apps = rows.join(known, "file_id", "left_semi").select(F.col("file_id").alias("app_id"), "md5")
    return _index(t, rows.join(known, "file_id", "left_anti").select("file_id", "md5")).first_match(apps, "file_id").select("app_id", "file_id")


@query(
    "indexed_imports",
    """
    WITH f AS (SELECT doc_id AS file_id, md5(text) AS md5, CAST(substr(source, 4) AS INTEGER) AS s FROM documents),
    early AS (SELECT md5 FROM f WHERE s < 10)
    SELECT file_id, md5, 1 AS batch FROM f WHERE s BETWEEN 10 AND 19 AND md5 NOT IN (SELECT md5 FROM early)
    UNION ALL SELECT file_id, md5, 2 FROM f WHERE s >= 20 AND md5 NOT IN (SELECT md5 FROM f WHERE s < 20)
    """,
)
def indexed_imports(t: Tables) -> DataFrame:
    """Two batches of imports: what is new to the index, which grows by each."""
    source = F.regexp_extract("firmware_id", "[0-9]+", 0).cast("int")
    rows = files(t).select("file_id", "md5", source.alias("s"))
    index = _index(t, rows.where("s < 10").select("file_id", "md5"))
    first = index.new(rows.where("s BETWEEN 10 AND 19").select("file_id", "md5")).select("file_id", "md5", F.lit(1).alias("batch")).checkpoint()
    index.add(first.select("file_id", "md5"))
    second = index.new(rows.where("s >= 20").select("file_id", "md5")).select("file_id", "md5", F.lit(2).alias("batch"))
    return first.unionByName(second)


@query(
    "indexed_duplicates",
    "SELECT md5(text) AS md5, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def indexed_duplicates(t: Tables) -> DataFrame:
    return _index(t, files(t).select("file_id", "md5")).duplicates("file_id")
