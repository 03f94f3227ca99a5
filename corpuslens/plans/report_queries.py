"""Reports and findings. Stored report texts are made from the rows of the given tables and parsed again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import CERTIFICATE_ATTRIBUTES, PRIVACY_CATEGORIES
from ..functions.documents import encode_json
from ..operators import reports as rp
from ..operators.rules import manifest_findings
from ..sources.reports import manifest_components, taint_results
from .registry import Tables, query
from .statistics_queries import listed, listed_sql

UNION_SQL = """
    SELECT 'ApkidReport' AS report_type, doc_id AS app_id, quality, NULL::VARCHAR AS results FROM labels
    UNION ALL SELECT 'ExodusReport', event_id, NULL, event_type FROM events
    UNION ALL SELECT 'QarkReport', item_id, NULL, md5(text) FROM benchmark
"""


def report_tables(t: Tables) -> dict[str, DataFrame]:
    return {
        "ApkidReport": t.labels.select(F.col("doc_id").alias("app_id"), "quality"),
        "ExodusReport": t.events.select(F.col("event_id").alias("app_id"), F.col("event_type").alias("results")),
        "QarkReport": t.benchmark.select(F.col("item_id").alias("app_id"), F.md5("text").alias("results")),
    }


@query("report_union", UNION_SQL)
def report_union(t: Tables) -> DataFrame:
    return rp.union_reports(report_tables(t)).select("report_type", "app_id", "quality", "results")


@query(
    "report_union_requested",
    f"SELECT report_type, app_id, results FROM ({UNION_SQL}) u WHERE report_type IN ('QarkReport', 'ExodusReport')",
)
def report_union_requested(t: Tables) -> DataFrame:
    return rp.union_reports(report_tables(t), ["QarkReport", "ExodusReport"]).select("report_type", "app_id", "results")


@query(
    "nested_findings_explode",
    """
    SELECT conv_id, role AS file_name, 'file_type' AS category, upper(role) AS match FROM conversations
    UNION ALL SELECT conv_id, role, 'compiler', 'r' || turn FROM conversations
    UNION ALL SELECT conv_id, role, 'compiler', 'dx' FROM conversations
    """,
)
def nested_findings_explode(t: Tables) -> DataFrame:
    matches = F.create_map(
        F.lit("file_type"), F.array(F.upper("role")),
        F.lit("compiler"), F.array(F.concat(F.lit("r"), F.col("turn")), F.lit("dx")),
    )
    payload = F.to_json(
        F.struct(F.lit("2.1").alias("apkid_version"), F.array(F.struct(F.col("role").alias("filename"), matches.alias("matches"))).alias("files"))
    )
    stored = t.conversations.select("conv_id", payload.alias("results"))
    return rp.match_findings(stored, "conv_id", "results")


@query(
    "issue_rows",
    """
    SELECT event_id, event_type AS category, CASE WHEN value > 5 THEN 'warning' ELSE 'info' END AS severity, 'n' || user_id AS name,
      CASE WHEN user_id % 2 = 0 THEN event_id::VARCHAR ELSE event_id || ',' || user_id END AS line_numbers, user_id % 2 = 0 AS single FROM events
    """,
)
def issue_rows(t: Tables) -> DataFrame:
    even = F.col("user_id") % 2 == 0
    line = F.when(even, F.col("event_id").cast("string")).otherwise(
        F.concat(F.lit("["), F.col("event_id"), F.lit(", "), F.col("user_id"), F.lit("]"))
    )
    payload = F.concat(
        F.lit('[{"category":"'), F.col("event_type"), F.lit('","severity":"'),
        F.when(F.col("value") > 5, "warning").otherwise("info"),
        F.lit('","name":"n'), F.col("user_id"), F.lit('","line_number":'), line, F.lit("}]"),
    )
    issues = rp.issue_rows(t.events.select("event_id", payload.alias("results")), "event_id", "results")
    return issues.select(
        "event_id", "category", "severity", "name",
        F.array_join(F.col("line_numbers").cast("array<string>"), ",").alias("line_numbers"),
        (F.size("line_numbers") == 1).alias("single"),
    )


@query(
    "privacy_report",
    f"""
    SELECT event_id, {listed_sql(PRIVACY_CATEGORIES, "user_id")} AS category, event_type AS entry FROM events
    UNION ALL SELECT event_id, {listed_sql(PRIVACY_CATEGORIES, "user_id")}, 'entry ' || user_id FROM events WHERE value > 5
    """,
)
def privacy_report(t: Tables) -> DataFrame:
    quoted = F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))
    more = F.when(F.col("value") > 5, F.concat(F.lit(',"entry '), F.col("user_id"), F.lit('"'))).otherwise(F.lit(""))
    payload = F.concat(
        F.lit('[{"application_information":[]},{"analysis_results":[["'), listed(PRIVACY_CATEGORIES, F.col("user_id")),
        F.lit('",['), quoted, more, F.lit(']],["none",[]]]}]'),
    )
    return rp.privacy_findings(t.events.select("event_id", payload.alias("results")), "event_id", "results")


@query(
    "privacy_status",
    "SELECT event_id, CASE WHEN value > 5 THEN 'completed' ELSE 'failed' END AS scan_status FROM events",
)
def privacy_status(t: Tables) -> DataFrame:
    payload = F.when(F.col("value") > 5, F.lit('[{},{"analysis_results":[["code_execution",[]]]}]')).otherwise(
        F.when(F.col("user_id") % 2 == 0, F.lit("[{}]")).otherwise(F.lit("not json"))
    )
    return t.events.select("event_id", rp.privacy_status(payload).alias("scan_status"))


@query(
    "tracker_header",
    """
    SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS handle, len(string_split(regexp_extract(url, '://([^/?#]+)', 1), '.'))::INT AS permissions,
      CASE WHEN html LIKE '%<table%' THEN 1 ELSE 0 END AS tracker_count FROM pages
    """,
)
def tracker_header(t: Tables) -> DataFrame:
    host = F.regexp_extract("url", "://([^/?#]+)", 1)
    application = F.struct(host.alias("handle"), F.split(host, "[.]").alias("permissions"))
    found = F.when(
        F.col("html").contains("<table"), F.array(F.struct(F.lit("T").alias("name"), F.lit(7).alias("id")))
    )
    payload = F.to_json(F.struct(application.alias("application"), found.alias("trackers")))
    header = rp.tracker_header(t.pages.select("page_id", payload.alias("results")), "page_id", "results")
    return header.select("page_id", "handle", F.size("permissions").alias("permissions"), "tracker_count")


@query(
    "merged_findings",
    """
    SELECT doc_id AS app_id, 'malware' AS kind, 'toxic' AS finding FROM labels WHERE toxic = 1
    UNION ALL SELECT event_id, 'vulnerability', event_type FROM events WHERE value > 5
    """,
)
def merged_findings(t: Tables) -> DataFrame:
    malware = t.labels.select(F.col("doc_id").alias("app_id"), F.when(F.col("toxic") == 1, "toxic").alias("finding"))
    weak = t.events.select(
        F.col("event_id").alias("app_id"), F.when(F.col("value") > 5, F.col("event_type")).otherwise("").alias("finding")
    )
    return rp.merge_findings(malware, weak).select("app_id", "kind", "finding")


# --- manifests -----------------------------------------------------------------------------

HTML_SQL = r"""
    SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
           len(regexp_extract_all(html, '<a href='))::INT AS links FROM pages
"""


@query("markup_manifest", HTML_SQL)
def markup_manifest(t: Tables) -> DataFrame:
    return t.pages.select(
        "page_id",
        F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.size(F.regexp_extract_all("html", F.lit("<a href="), 0)).alias("links"),
    )


def page_manifests(t: Tables) -> DataFrame:
    """A manifest per page: pages with a query are exported, pages under https have an intent filter."""
    exported = F.when(F.col("url").contains("?"), "true").otherwise("false")
    action = '<intent-filter><action android:name="VIEW"/></intent-filter>'
    inner = F.when(F.col("url").startswith("https"), F.lit(action)).otherwise(F.lit(""))
    debuggable = F.when(F.col("url").endswith("#top"), "true").otherwise("false")

    def component(kind: str):
        return F.concat(
            F.lit(f'<{kind} android:name="com.p{kind[0].upper()}'), F.col("page_id"), F.lit('" android:exported="'), exported,
            F.lit('">'), inner, F.lit(f"</{kind}>"),
        )

    xml = F.concat(
        F.lit('<manifest xmlns:android="http://schemas.android.com/apk/res/android" package="com.p'), F.col("page_id"),
        F.lit('"><application android:debuggable="'), debuggable, F.lit('">'),
        component("activity"), component("receiver"), F.lit("</application></manifest>"),
    )
    return t.pages.select("page_id", "url", xml.alias("manifest"))


@query(
    "manifest_flags",
    """
    SELECT page_id AS app_id, 'com.p' || page_id AS name, 'CWE489' AS checker FROM pages WHERE url LIKE '%#top'
    UNION ALL SELECT page_id, 'com.pA' || page_id, 'CWE926' FROM pages WHERE url LIKE '%?%' AND url LIKE 'https%'
    UNION ALL SELECT page_id, 'com.pR' || page_id, 'CWE925' FROM pages WHERE url LIKE '%?%' AND html NOT LIKE '%<table%'
    """,
)
def manifest_flags(t: Tables) -> DataFrame:
    components = manifest_components(page_manifests(t), "page_id", "manifest")
    verified = t.pages.where(F.col("html").contains("<table")).select(
        F.col("page_id").alias("app_id"), F.concat(F.lit("com.pR"), F.col("page_id")).alias("name")
    )
    return manifest_findings(components, verified)


@query(
    "taint_results",
    """SELECT page_id, CASE WHEN url LIKE '%?%' THEN url ELSE '{"NoMatch":"No taints matched!"}' END AS results FROM pages""",
)
def taint_result_texts(t: Tables) -> DataFrame:
    text = F.when(F.col("url").contains("?"), F.col("url")).otherwise(F.lit(" "))
    return t.pages.select("page_id", taint_results(text).alias("results"))


@query(
    "nested_component_map",
    """
    SELECT conv_id, role AS component_type, 'c' || turn % 3 AS component, string_agg(DISTINCT 'A' || turn % 2, ',' ORDER BY 'A' || turn % 2) AS actions
    FROM conversations GROUP BY 1, 2, 3
    """,
)
def nested_component_map(t: Tables) -> DataFrame:
    filters = t.conversations.select(
        "conv_id",
        F.col("role").alias("component_type"),
        F.concat(F.lit("c"), F.col("turn") % 3).alias("component"),
        F.concat(F.lit("A"), F.col("turn") % 2).alias("action"),
    )
    nested = rp.component_filters(filters, "conv_id")
    types = nested.select("conv_id", F.explode("intent_filters").alias("component_type", "components"))
    flat = types.select("conv_id", "component_type", F.explode("components").alias("component", "actions"))
    return flat.select("conv_id", "component_type", "component", F.array_join("actions", ",").alias("actions"))


@query(
    "json_encode",
    """SELECT conv_id, turn, '{"id":"' || conv_id || '","role":"' || role || '","tags":' || CASE WHEN role < 't' || turn THEN '["' || role || '","t' || turn || '"]' ELSE '["t' || turn || '","' || role || '"]' END || '}' AS doc FROM conversations""",
)
def json_encode(t: Tables) -> DataFrame:
    return t.conversations.select(
        "conv_id",
        "turn",
        encode_json(
            F.col("conv_id").cast("string").alias("id"),
            F.col("role"),
            F.array_sort(F.array("role", F.concat(F.lit("t"), F.col("turn")))).alias("tags"),
        ).alias("doc"),
    )


@query(
    "certificate_projection",
    """
    SELECT s_suppkey AS app_id, md5(s_name) AS sha1, 'CN=' || n_name AS issuer, 'CN=' || s_name AS subject,
      CASE s_suppkey % 3 WHEN 0 THEN 'DSA' WHEN 1 THEN 'EC' ELSE 'RSA' END AS public_key_algorithm,
      CASE s_suppkey % 3 WHEN 0 THEN 'sha1' ELSE '' END AS public_key_hash_algo_dsa,
      CASE s_suppkey % 3 WHEN 1 THEN 'p256' ELSE '' END AS public_key_curve, '' AS serial_number
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
    """,
)
def certificate_projection(t: Tables) -> DataFrame:
    decoded = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("app_id"),
        F.md5("s_name").alias("sha1"),
        F.concat(F.lit("CN="), "n_name").alias("issuer"),
        F.concat(F.lit("CN="), "s_name").alias("subject"),
        F.element_at(F.array(F.lit("DSA"), F.lit("EC"), F.lit("RSA")), (F.col("s_suppkey") % 3 + 1).cast("int")).alias(
            "public_key_algorithm"
        ),
        F.lit("sha1").alias("public_key_hash_algo_dsa"),
        F.lit("p256").alias("public_key_curve"),
    )
    wanted = [
        a for a in CERTIFICATE_ATTRIBUTES
        if a in ("sha1", "issuer", "subject", "public_key_algorithm", "public_key_hash_algo_dsa", "public_key_curve", "serial_number")
    ]
    return rp.certificates(decoded, wanted)


@query(
    "validity_window",
    """
    SELECT o_orderkey, TIMESTAMP '1998-01-01' BETWEEN o_orderdate AND o_orderdate + INTERVAL 365 DAY AS valid,
      o_orderdate + INTERVAL 365 DAY < TIMESTAMP '1998-01-01' AS expired FROM orders
    """,
)
def validity_window(t: Tables) -> DataFrame:
    moment = F.lit("1998-01-01").cast("timestamp_ntz")
    until = F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS")
    return t.orders.select(
        "o_orderkey", rp.valid_at(moment, "o_orderdate", until).alias("valid"), (until < moment).alias("expired")
    )
