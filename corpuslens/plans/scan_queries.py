"""The list query and its variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import inventory as inv
from ..operators import scan as sc
from ..operators.scanners import job_records
from .registry import Tables, query


@query(
    "equality_filter_scan",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
)
def equality_filter_scan(t: Tables) -> DataFrame:
    filters = {"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "o_custkey": None}
    return sc.scan(t.orders, filters=filters, columns=["o_orderkey", "o_custkey"], id_col="o_orderkey")


@query(
    "id_list_scan",
    "SELECT doc_id, source FROM documents WHERE lang = 'en' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)",
)
def id_list_scan(t: Tables) -> DataFrame:
    ids = t.labels.where("quality = 0").select("doc_id")
    return sc.scan(t.documents, ids=ids, filters={"lang": "en"}, columns=["doc_id", "source"], id_col="doc_id")


@query(
    "list_column_equality",
    "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src1'",
)
def list_column_equality(t: Tables) -> DataFrame:
    tagged = t.documents.select("doc_id", F.array("lang", "source").alias("tags"))
    return sc.scan(tagged, filters={"tags": ["en", "src1"]}, columns=["doc_id"], id_col="doc_id")


@query(
    "list_column_overlap",
    "SELECT doc_id FROM documents WHERE lang = 'es' OR source = 'src1'",
)
def list_column_overlap(t: Tables) -> DataFrame:
    tagged = t.documents.select("doc_id", F.array("lang", "source").alias("tags"))
    return sc.scan(tagged, filters={"tags": ["es", "src1"]}, columns=["doc_id"], id_col="doc_id", any_of_list=True)


@query(
    "missing_attribute",
    "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL",
)
def missing_attribute(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return joined.where(sc.attribute_missing("quality")).select("doc_id")


@query(
    "existing_attribute",
    """
    SELECT doc_id, toxic FROM documents JOIN labels USING (doc_id)
    WHERE toxic IS NOT NULL AND source IN (SELECT source FROM documents WHERE lang = 'es')
    """,
)
def existing_attribute(t: Tables) -> DataFrame:
    documents = t.documents.select("doc_id", "source", "lang")
    rows = documents.join(t.labels, "doc_id").where(F.col("toxic").isNotNull())
    wanted = documents.where("lang = 'es'").select("source").distinct()
    return sc.with_ids(rows, wanted, "source").select("doc_id", "toxic")


@query("default_predicate", "SELECT doc_id FROM documents WHERE lang = 'de'")
def default_predicate(t: Tables) -> DataFrame:
    return sc.default_scope(t.documents, None, "doc_id", F.col("lang") == "de").select("doc_id")


@query(
    "job_record_filter",
    """
    SELECT o_orderkey AS job_id, o_orderpriority AS queue, o_orderstatus AS status FROM orders
    WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'F'
    """,
)
def job_record_filter(t: Tables) -> DataFrame:
    jobs = t.orders.select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_orderpriority").alias("queue"),
        F.col("o_orderstatus").alias("status"),
    )
    return job_records(jobs, queue="2-HIGH", status="F")


@query(
    "first_match",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 1",
)
def first_match(t: Tables) -> DataFrame:
    return sc.first_row(t.orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey"), "o_orderkey")


@query("head_batch", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 100")
def head_batch(t: Tables) -> DataFrame:
    return sc.head_batch(t.orders.where("o_orderstatus = 'O'").select("o_orderkey"), "o_orderkey", 100)


@query(
    "validated_filter_schema",
    "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'MACHINERY'",
)
def validated_filter_schema(t: Tables) -> DataFrame:
    accepted = sc.filter_arguments(t.customer.schema)
    filters = {k: v for k, v in {"c_nationkey": 7, "c_mktsegment": "MACHINERY"}.items() if k in accepted}
    return sc.scan(t.customer, filters=filters, columns=["c_custkey", "c_name"], id_col="c_custkey")


@query(
    "distinct_on_first",
    "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents WHERE source IS NOT NULL GROUP BY source)",
)
def distinct_on_first(t: Tables) -> DataFrame:
    return sc.distinct_on(t.documents.select("doc_id", "lang", "source"), "source", "doc_id")


@query(
    "app_ids_of_firmware",
    """
    SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)
    UNION SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'
    """,
)
def app_ids_of_firmware(t: Tables) -> DataFrame:
    apps = t.orders.select("o_orderkey", F.col("o_custkey").alias("firmware_id"))
    firmware = t.customer.where("c_nationkey = 3").select(F.col("c_custkey").alias("firmware_id"))
    direct = t.orders.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").select("o_orderkey")
    return inv.requested_apps(direct, apps, firmware, "o_orderkey", "firmware_id")


@query(
    "report_dereference",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, o.o_orderstatus, o.o_custkey FROM lineitem
    LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON l_orderkey = o_orderkey
    """,
)
def report_dereference(t: Tables) -> DataFrame:
    reports = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    apps = t.orders.where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus", "o_custkey")
    return inv.dereference(reports, apps, "l_orderkey", "o_orderkey").drop("o_orderkey")
