"""The list queries of the API over views of the given tables (Q01-Q10, Q12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..corpus import Corpus
from ..schemas import schema_of
from .registry import Tables, query


def viewed(t: Tables, **tables: tuple[DataFrame, dict[str, Column]]) -> Corpus:
    """A corpus of views over the given tables: the columns named, all others null. Nothing is copied."""
    views = {}
    for name, (rows, columns) in tables.items():
        fields = schema_of(name).fields
        views[name] = rows.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    return Corpus(t.spark, views=views)


def tagged(letter: str, *columns: str) -> Column:
    return F.concat(F.lit(letter), F.concat_ws("_", *columns))


def firmware(t: Tables):
    columns = {"id": tagged("f", "c_custkey"), "os_vendor": F.col("c_mktsegment"), "version_detected": F.col("c_nationkey"), "original_filename": F.col("c_name")}
    return t.customer, columns


def apps(t: Tables):
    return t.orders, {"id": tagged("a", "o_orderkey"), "firmware_id_reference": tagged("f", "o_custkey"), "filename": F.col("o_orderpriority")}


@query(
    "firmware_list",
    "SELECT 'f' || c_custkey AS id, c_name AS original_filename FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3",
)
def firmware_list(t: Tables) -> DataFrame:
    corpus = viewed(t, android_firmware=firmware(t))
    return corpus.list("android_firmware", filters={"os_vendor": "BUILDING", "version_detected": 3}, columns=["id", "original_filename"])


@query("firmware_id_list", "SELECT 'f' || c_custkey AS id FROM customer WHERE c_mktsegment = 'MACHINERY'")
def firmware_id_list(t: Tables) -> DataFrame:
    return viewed(t, android_firmware=firmware(t)).firmware_ids({"os_vendor": "MACHINERY"})


@query("firmware_page", "SELECT 'f' || c_custkey AS id FROM customer WHERE 'f' || c_custkey > 'f3' ORDER BY 1 LIMIT 25")
def firmware_page(t: Tables) -> DataFrame:
    return viewed(t, android_firmware=firmware(t)).firmware_page("f3", 25).select("id")


@query(
    "app_list_of_firmware",
    "SELECT 'a' || o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderpriority = '1-URGENT'",
)
def app_list_of_firmware(t: Tables) -> DataFrame:
    corpus = viewed(t, android_firmware=firmware(t), android_app=apps(t))
    return corpus.app_ids(corpus.firmware_ids({"os_vendor": "BUILDING"}), {"filename": "1-URGENT"})


@query(
    "firmware_file_list",
    "SELECT 'x' || l_orderkey || '_' || l_linenumber AS id, l_quantity::BIGINT AS file_size_bytes FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey = 7",
)
def firmware_file_list(t: Tables) -> DataFrame:
    columns = {
        "id": tagged("x", "l_orderkey", "l_linenumber"), "firmware_id_reference": tagged("f", "l_suppkey"),
        "partition_name": F.col("l_returnflag"), "file_size_bytes": F.col("l_quantity"),
    }
    corpus = viewed(t, firmware_file=(t.lineitem, columns))
    wanted = {"partition_name": "R", "firmware_id_reference": "f7"}
    return corpus.list("firmware_file", filters=wanted, columns=["id", "file_size_bytes"])


@query(
    "build_prop_list",
    """
    SELECT min('p' || lpad(o_orderkey::VARCHAR, 9, '0')) AS id, 'f' || o_custkey AS firmware_id_reference FROM orders
    WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY o_custkey
    """,
)
def build_prop_list(t: Tables) -> DataFrame:
    """Files that hold both keys and one of two values, the first per firmware."""
    keys = F.when(F.col("o_orderstatus") == "F", F.create_map(F.lit("ro_a"), "o_orderpriority", F.lit("ro_b"), F.lit("x")))
    columns = {
        "id": F.concat(F.lit("p"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")), "firmware_id_reference": tagged("f", "o_custkey"),
        "properties": F.coalesce(keys, F.create_map(F.lit("ro_a"), "o_orderpriority")),
    }
    corpus = viewed(t, build_prop_file=(t.orders, columns))
    found = corpus.property_files(keys=["ro_a", "ro_b"], values=["1-URGENT", "2-HIGH"], distinct_on="firmware_id_reference")
    return found.select("id", "firmware_id_reference")


def reports(t: Tables, status: str):
    columns = {
        "id": tagged("r", "o_orderkey"), "android_app_id_reference": tagged("a", "o_orderkey"), "scan_status": F.lit(status),
        "results": F.to_json(F.struct("o_orderpriority")),
    }
    return t.orders.where(F.col("o_orderstatus") == status), columns


@query(
    "scanner_report_list",
    """
    SELECT CASE o_orderstatus WHEN 'F' THEN 'ExodusReport' ELSE 'QarkReport' END AS report_type, 'r' || o_orderkey AS id FROM orders
    WHERE o_orderstatus IN ('F', 'O')
    """,
)
def scanner_report_list(t: Tables) -> DataFrame:
    """Reports of the requested types; the third type is there, too, and not read."""
    corpus = viewed(t, ExodusReport=reports(t, "F"), QarkReport=reports(t, "O"), SuperReport=reports(t, "P"))
    return corpus.scan_reports(requested=["ExodusReport", "QarkReport"]).select("report_type", "id")


@query(
    "report_list_of_scanner",
    "SELECT 'r' || o_orderkey AS id, o_orderpriority AS app_filename FROM orders WHERE o_orderstatus = 'F'",
)
def report_list_of_scanner(t: Tables) -> DataFrame:
    """The reports of one scanner with the app they are about."""
    corpus = viewed(t, ExodusReport=reports(t, "F"), android_app=apps(t))
    return corpus.reports_with_apps("ExodusReport").select("id", "app_filename")


@query(
    "statistics_list",
    "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 10",
)
def statistics_list(t: Tables) -> DataFrame:
    counts = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    columns = {"id": F.col("event_type"), "report_name": F.lit("events"), "attribute": F.lit("event_type"), "value": F.col("event_type"), "n": F.col("n")}
    corpus = viewed(t, statistics_report=(counts, columns))
    return corpus.list("statistics_report", filters={"report_name": "events"}, columns=["value", "n"]).where("n > 10")


@query("fuzzy_hash_list", "SELECT 'h' || doc_id AS id, md5(text) AS digest FROM documents WHERE source = 'src3'")
def fuzzy_hash_list(t: Tables) -> DataFrame:
    """Stored digests of one firmware; any text stands for a digest here."""
    columns = {"id": tagged("h", "doc_id"), "firmware_id_reference": F.col("source"), "digest": F.md5("text")}
    corpus = viewed(t, tlsh_hash=(t.documents, columns))
    return corpus.list("tlsh_hash", filters={"firmware_id_reference": "src3"}, columns=["id", "digest"])


@query("certificate_list", "SELECT 'c' || s_suppkey AS id, s_name AS subject FROM supplier WHERE s_nationkey = 5")
def certificate_list(t: Tables) -> DataFrame:
    columns = {"id": tagged("c", "s_suppkey"), "subject": F.col("s_name"), "issuer": F.col("s_nationkey"), "is_ca": F.col("s_nationkey") == 5}
    corpus = viewed(t, app_certificate=(t.supplier, columns))
    return corpus.list("app_certificate", filters={"is_ca": True}, columns=["id", "subject"])


@query("scanner_log_list", "SELECT 'l' || event_id AS id, props AS message FROM events WHERE event_type = 'click'")
def scanner_log_list(t: Tables) -> DataFrame:
    columns = {"id": tagged("l", "event_id"), "level": F.col("event_type"), "message": F.col("props"), "timestamp": F.col("ts")}
    corpus = viewed(t, apk_scanner_log=(t.events, columns))
    return corpus.list("apk_scanner_log", filters={"level": "click"}, columns=["id", "message"])


@query("aecs_job_list", "SELECT 'j' || n_nationkey AS id FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY 1")
def aecs_job_list(t: Tables) -> DataFrame:
    """Jobs by architecture; a job's list of firmware is a column of its own."""
    jobs = t.customer.groupBy("c_nationkey").agg(F.collect_list(tagged("f", "c_custkey")).alias("firmware"))
    jobs = jobs.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    columns = {"id": tagged("j", "c_nationkey"), "firmware_id_list": F.col("firmware"), "arch": F.col("n_regionkey")}
    corpus = viewed(t, aecs_job=(jobs, columns))
    return corpus.list("aecs_job", filters={"arch": "1"}, columns=["id"])


@query(
    "corpus_without_firmware",
    """
    WITH gone AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT 'android_firmware' AS kept_in, count(*) AS n FROM customer WHERE c_custkey NOT IN (FROM gone)
    UNION ALL SELECT 'android_app', count(*) FROM orders WHERE o_custkey NOT IN (FROM gone)
    UNION ALL SELECT 'ExodusReport', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (FROM gone)
    """,
)
def corpus_without_firmware(t: Tables) -> DataFrame:
    """Deleting firmware takes its apps and their reports along."""
    corpus = viewed(t, android_firmware=firmware(t), android_app=apps(t), ExodusReport=reports(t, "F"))
    gone = corpus.firmware_ids({"os_vendor": "BUILDING"})
    kept = corpus.without("android_firmware", gone, ["android_firmware", "android_app", "ExodusReport"])
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kept_in"), "n") for name, df in kept.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])
