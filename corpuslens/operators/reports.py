"""Scanner reports to finding tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_col, unfold
from ..functions.documents import list_of_scalar_or_list

MATCH_SCHEMA = (
    "struct<apkid_version:string,rules_sha256:string,"
    "files:array<struct<filename:string,matches:map<string,array<string>>>>>"
)
ISSUE_SCHEMA = (
    "array<struct<category:string,severity:string,description:string,name:string,line_number:string,"
    "file_object:string,apk_exploit_dict:map<string,string>>>"
)
TRACKER_SCHEMA = (
    "struct<application:struct<handle:string,version_name:string,version_code:string,uaid:string,"
    "name:string,permissions:array<string>,libraries:array<string>>,"
    "apk:struct<path:string,checksum:string>,trackers:array<struct<name:string,id:bigint>>>"
)
PRIVACY_CATEGORY_COUNT = 9


def union_reports(reports: Mapping[str, DataFrame], requested: Sequence[str] | None = None) -> DataFrame:
    """All report tables under one header; only the requested types are read."""
    chosen = [name for name in reports if requested is None or name in requested]
    if not chosen:
        raise ValueError("none of the requested report types exists")
    tagged = [reports[name].withColumn("report_type", F.lit(name)) for name in chosen]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def match_findings(reports: DataFrame, id_col: str, payload: Column | str) -> DataFrame:
    """Match report: one row per nested file, category and match."""
    parsed = F.from_json(as_col(payload), MATCH_SCHEMA)
    files = unfold(reports, [id_col], parsed["files"], "_file")
    categories = files.select(
        id_col, F.col("_file.filename").alias("file_name"), F.explode("_file.matches").alias("category", "_found")
    )
    return categories.select(id_col, "file_name", "category", F.explode("_found").alias("match"))


def issue_rows(reports: DataFrame, id_col: str, payload: Column | str) -> DataFrame:
    """Issue report: one row per issue; a single line number becomes a list of one."""
    parsed = F.from_json(as_col(payload), ISSUE_SCHEMA)
    issues = unfold(reports, [id_col], parsed, "_issue")
    return issues.select(
        id_col,
        *[F.col(f"_issue.{name}").alias(name) for name in ("category", "severity", "description", "name")],
        list_of_scalar_or_list(F.col("_issue.line_number")).alias("line_numbers"),
        F.col("_issue.file_object").alias("file_object"),
        F.coalesce(F.col("_issue.apk_exploit_dict"), F.create_map().cast("map<string,string>")).alias(
            "apk_exploit_dict"
        ),
    )


def privacy_findings(reports: DataFrame, id_col: str, payload: Column | str) -> DataFrame:
    """Privacy report: the pairs of ``analysis_results`` in the second element, one row per entry."""
    results = F.expr("variant_get(_doc, '$[1].analysis_results', 'array<variant>')")
    documents = reports.select(id_col, F.try_parse_json(as_col(payload)).alias("_doc"))
    pairs = unfold(documents, [id_col], results, "_pair").select(
        id_col,
        F.expr("variant_get(_pair, '$[0]', 'string')").alias("category"),
        F.expr("variant_get(_pair, '$[1]', 'array<string>')").alias("_entries"),
    )
    return unfold(pairs, [id_col, "category"], "_entries", "entry")


def privacy_status(payload: Column | str) -> Column:
    """A privacy report without results counts as failed."""
    found = F.try_variant_get(F.try_parse_json(as_col(payload)), "$[1].analysis_results", "array<variant>")
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, F.lit("completed")).otherwise(F.lit("failed"))


def tracker_header(reports: DataFrame, id_col: str, payload: Column | str) -> DataFrame:
    """Tracker report: package header with its permissions, libraries and number of trackers."""
    parsed = F.from_json(as_col(payload), TRACKER_SCHEMA)
    return reports.select(id_col, parsed.alias("_r")).select(
        id_col,
        "_r.application.handle",
        "_r.application.version_name",
        "_r.application.permissions",
        "_r.application.libraries",
        F.coalesce(F.size("_r.trackers"), F.lit(0)).alias("tracker_count"),
    )


def detect_trackers(hosts: DataFrame, signatures: DataFrame, id_col: str, host_col: str) -> DataFrame:
    """Which trackers a row calls.

    Takes ``signatures(tracker, domain)``. A host offers itself with each of its parent domains, so a
    signature matches a domain and everything below it by equality, whatever the number of signatures.
    """
    labels = F.split(F.col(host_col), r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    offered = hosts.select(id_col, F.explode(suffixes).alias("domain"))
    return offered.join(signatures, "domain").select(id_col, "tracker").distinct()


def pattern_findings(df: DataFrame, id_col: str, text_col: str, patterns: Mapping[str, str]) -> DataFrame:
    """Multi-pattern scan of a text column: one row per rule and match, from one pass over the text."""
    per_rule = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"),
                F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0)).alias("found"),
            )
            for rule, pattern in patterns.items()
        ]
    )
    hits = F.filter(per_rule, lambda hit: F.size(hit["found"]) > 0)
    return unfold(df, [id_col], hits, "_hit").select(
        id_col, F.col("_hit.rule").alias("rule"), F.explode("_hit.found").alias("match")
    )


def merge_findings(malware: DataFrame, vulnerabilities: DataFrame) -> DataFrame:
    """One finding table of two scans; findings without content are dropped."""
    merged = malware.withColumn("kind", F.lit("malware")).unionByName(
        vulnerabilities.withColumn("kind", F.lit("vulnerability")), allowMissingColumns=True
    )
    return merged.where(F.col("finding").isNotNull() & (F.col("finding") != ""))


def component_filters(filters: DataFrame, app_col: str) -> DataFrame:
    """Intent filters as a nested map per app: component type to component to actions.

    Takes ``filters(app, component_type, component, action)``. The components of one app fit one row.
    """
    per_component = filters.groupBy(app_col, "component_type", "component").agg(
        F.array_sort(F.collect_set("action")).alias("actions")
    )
    per_type = per_component.groupBy(app_col, "component_type").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("component", "actions")))).alias("components")
    )
    return per_type.groupBy(app_col).agg(
        F.map_from_entries(F.collect_list(F.struct("component_type", "components"))).alias("intent_filters")
    )


def certificates(decoded: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Certificate attributes with their defaults: algorithm-specific ones are empty for other algorithms."""
    columns = []
    for name in attributes:
        column = F.col(name) if name in decoded.columns else F.lit("")
        if name == "public_key_hash_algo_dsa":
            column = F.when(F.col("public_key_algorithm") == "DSA", column).otherwise(F.lit(""))
        elif name == "public_key_curve":
            column = F.when(F.col("public_key_algorithm") == "EC", column).otherwise(F.lit(""))
        columns.append(column.alias(name))
    return decoded.select("app_id", *columns)


def valid_at(moment: Column, not_before: Column | str, not_after: Column | str) -> Column:
    """Validity of a certificate at a point in time, bounds included."""
    return (moment >= as_col(not_before)) & (moment <= as_col(not_after))
