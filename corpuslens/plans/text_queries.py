"""Strings: metrics, entropy, addresses, flags, secrets, trackers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, entropies, language, text_flags, url_parts, word_count
from ..operators import patterns as pt
from ..operators import quality as ql
from ..operators import reports as rp
from ..operators.scan import valid_object_id
from .registry import Tables, query, sql_text

# Secret patterns, by rule name.
SECRET_PATTERNS = {
    "token": 'token = "[0-9a-f]{40}"',
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}",
    "google_api_key": "AIza[0-9A-Za-z_-]{35}",
    "aws_access_key": "AKIA[0-9A-Z]{16}",
    "private_key": "-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "ipv4": "(?:[0-9]{1,3}[.]){3}[0-9]{1,3}",
    "url": "https?://[^\\s\"'<>]+",
}
TRACKERS = {
    "Ads": "ads-track.example.org",
    "Pills": "cheap-pills.example.com",
    "Casino": "casino-win.example.org",
    "Farm": "spam-farm.example.org",
    "Bets": "free-bets.example.com",
}


def secret_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT doc_id, {sql_text(rule)} AS rule, unnest(regexp_extract_all(text, {sql_text(pattern)})) AS match FROM documents"
        for rule, pattern in SECRET_PATTERNS.items()
    )


@query("secret_scan", secret_sql())
def secret_scan(t: Tables) -> DataFrame:
    return rp.pattern_findings(t.spread("documents", "doc_id"), "doc_id", "text", SECRET_PATTERNS)


@query("secret_table_scan", secret_sql())
def secret_table_scan(t: Tables) -> DataFrame:
    """The same findings from a table of patterns, which may be of any size."""
    rules = t.spark.createDataFrame(list(SECRET_PATTERNS.items()), "rule string, pattern string")
    return pt.findings(t.spread("documents", "doc_id"), "doc_id", "text", rules, "rule", "pattern")


# Patterns made of the benchmark: the first words of a text, whatever stands between them.
_OPENING = "[a-z]+[^a-z]+[a-z]+[^a-z]+[a-z]+"


@query(
    "passage_patterns",
    f"""
    WITH p AS (SELECT item_id, '(?i)' || regexp_replace(regexp_extract(lower(text), '{_OPENING}'), '[^a-z]+', '[^a-z]+', 'g') AS pattern
               FROM benchmark WHERE regexp_matches(lower(text), '{_OPENING}'))
    SELECT doc_id, item_id FROM documents JOIN p ON regexp_matches(text, pattern)
    """,
)
def passage_patterns(t: Tables) -> DataFrame:
    """A table of patterns as large as the benchmark, matched against every document."""
    opening = F.regexp_extract(F.lower("text"), _OPENING, 0)
    pattern = F.concat(F.lit("(?i)"), F.regexp_replace(opening, "[^a-z]+", "[^a-z]+"))
    rules = t.benchmark.where(opening != "").select("item_id", pattern.alias("pattern"))
    documents = t.spread("documents", "doc_id").select("doc_id", "text")
    return pt.matches(documents, "text", rules, "pattern").select("doc_id", "item_id")


@query(
    "string_metrics",
    r"SELECT conv_id, turn, length(text)::INT AS string_length, len(regexp_extract_all(text, '\S+'))::INT AS number_of_words_estimate FROM conversations",
)
def string_metrics(t: Tables) -> DataFrame:
    return t.conversations.select(
        "conv_id", "turn", F.length("text").alias("string_length"), word_count("text").alias("number_of_words_estimate")
    )


@query(
    "entropy",
    """
    WITH c AS (SELECT conv_id, turn, unnest(string_split(text, '')) AS ch FROM conversations),
    n AS (SELECT conv_id, turn, ch, count(*) AS k FROM c GROUP BY 1, 2, 3),
    p AS (SELECT conv_id, turn, k / sum(k) OVER (PARTITION BY conv_id, turn) AS p FROM n)
    SELECT conv_id, turn, round(-sum(p * ln(p)), 6) AS natural_entropy, round(-sum(p * log2(p)), 6) AS shannon_entropy,
           round(-sum(p * log10(p)), 6) AS hartley_entropy FROM p GROUP BY 1, 2
    """,
)
def entropy(t: Tables) -> DataFrame:
    rows = t.spread("conversations", "conv_id", "turn").select("conv_id", "turn", entropies("text").alias("e"))
    names = ("natural_entropy", "shannon_entropy", "hartley_entropy")
    return rows.select("conv_id", "turn", *[F.round(f"e.{n}", 6).alias(n) for n in names])


@query(
    "url_parts",
    r"""
    SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS url_scheme, regexp_extract(url, '://([^/?#]+)', 1) AS url_domain,
           regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS url_path, '' AS url_params,
           regexp_extract(url, '\?([^#]*)', 1) AS url_query, regexp_extract(url, '#(.*)$', 1) AS url_fragment FROM pages
    """,
)
def url_part_columns(t: Tables) -> DataFrame:
    return t.pages.select("page_id", *[c.alias(n) for n, c in url_parts("url").items()])


FLAG_SQL = r"""
    SELECT doc_id, regexp_matches(trim(text), '^[+-]?[0-9]+([.][0-9]+)?$') AS isNumeric,
      regexp_matches(trim(text), '^[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]+[^\s]*$') AS isURL,
      regexp_matches(trim(text), '^(/[^/\s]+)+/?$') AS isFilePath,
      regexp_matches(text, '(?i)^\s*(select\s.+\sfrom|insert\s+into|update\s.+\sset|delete\s+from|create\s+table)\s') AS isSQLStatement,
      regexp_matches(trim(text), '^(?:[A-Za-z0-9+/]{4}){4,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$') OR regexp_matches(trim(text), '^(?:[0-9a-fA-F]{2}){16,}$') AS isEncoded,
      regexp_matches(text, '(?i)(api[_-]?key|secret|token|passw(or)?d)\s*[=:]\s*["'']?[A-Za-z0-9/+_-]{8,}') AS isSecret,
      len(string_split_regex(trim(text), '\s+')) >= 4 AS isNaturalLanguage FROM documents
"""


@query(
    "text_flags",
    f"""
    SELECT *, NOT (isNumeric OR isURL OR isFilePath OR isSQLStatement OR isEncoded OR isSecret OR isNaturalLanguage) AS isUnknownCategory
    FROM ({FLAG_SQL}) f
    """,
)
def text_flag_columns(t: Tables) -> DataFrame:
    return t.spread("documents", "doc_id").select("doc_id", *[c.alias(n) for n, c in text_flags("text").items()])


LANGUAGE_SQL = (
    r"""
    WITH w AS (SELECT doc_id, string_split_regex(lower(text), '[^\p{L}]+') AS w FROM documents),
    s AS ("""
    + " UNION ALL ".join(
        f"SELECT doc_id, '{code}' AS code, len(list_filter(w, lambda x: list_contains([{', '.join(sql_text(x) for x in words)}], x))) AS score FROM w"
        for code, words in STOP_WORDS.items()
    )
    + """),
    b AS (SELECT doc_id, code, score, sum(score) OVER (PARTITION BY doc_id) AS total,
                 row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, code DESC) AS k FROM s)
    SELECT doc_id, CASE WHEN total > 0 THEN code END AS language_code, round(CASE WHEN total > 0 THEN score / total ELSE 0 END, 6) AS language_confidence
    FROM b WHERE k = 1
    """
)


@query("language_scores", LANGUAGE_SQL)
def language_columns(t: Tables) -> DataFrame:
    rows = t.spread("documents", "doc_id").select("doc_id", language("text").alias("found"))
    return rows.select(
        "doc_id", "found.language_code", F.round("found.language_confidence", 6).alias("language_confidence")
    )


@query(
    "tracker_match",
    f"""
    WITH h AS (SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages),
    s(tracker, domain) AS (VALUES {", ".join(f"({sql_text(k)}, {sql_text(d)})" for k, d in TRACKERS.items())})
    SELECT DISTINCT page_id, tracker FROM h JOIN s ON host = domain OR host LIKE '%.' || domain
    """,
)
def tracker_match(t: Tables) -> DataFrame:
    signatures = t.spark.createDataFrame(list(TRACKERS.items()), "tracker string, domain string")
    hosts = t.pages.select("page_id", F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"))
    return rp.detect_trackers(hosts, signatures, "page_id", "host")


@query(
    "quality_errors",
    r"""
    WITH c AS (SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN lower(c_mktsegment) || '@example' ELSE c_mktsegment || '@example.com' END AS email,
                      CASE WHEN c_nationkey > 20 THEN 'x' ELSE c_mktsegment END AS user_name, c_name AS api_key, md5(c_name)[1:24] AS object_id,
                      c_nationkey AS threads FROM customer)
    SELECT c_custkey, array_to_string(list_filter([
        CASE WHEN NOT regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$') THEN 'email' END,
        CASE WHEN NOT (length(user_name) BETWEEN 3 AND 30) THEN 'user name length' END,
        CASE WHEN NOT regexp_matches(user_name, '^[a-zA-Z0-9._-]+$') THEN 'user name characters' END,
        CASE WHEN length(api_key) < 10 THEN 'api key length' END,
        CASE WHEN NOT regexp_matches(api_key, '^[a-zA-Z0-9._-]+$') THEN 'api key characters' END,
        CASE WHEN NOT regexp_matches(object_id, '^[0-9a-fA-F]{24}$') THEN 'object id' END,
        CASE WHEN NOT (threads BETWEEN 1 AND 30) THEN 'threads' END], lambda x: x IS NOT NULL), '; ') AS errors FROM c
    """,
)
def quality_errors(t: Tables) -> DataFrame:
    rows = t.customer.select(
        "c_custkey",
        F.when(F.col("c_nationkey") < 5, F.concat(F.lower("c_mktsegment"), F.lit("@example")))
        .otherwise(F.concat(F.col("c_mktsegment"), F.lit("@example.com")))
        .alias("email"),
        F.when(F.col("c_nationkey") > 20, F.lit("x")).otherwise(F.col("c_mktsegment")).alias("user_name"),
        F.col("c_name").alias("api_key"),
        F.substring(F.md5("c_name"), 1, 24).alias("object_id"),
        F.col("c_nationkey").alias("threads"),
    )
    rules = {
        "email": ql.email_rule("email"),
        **ql.user_name_rules("user_name"),
        **ql.api_key_rules("api_key"),
        "object id": valid_object_id("object_id"),
        "threads": ql.thread_count_rule("threads"),
    }
    return rows.select("c_custkey", F.array_join(ql.errors_of(rules), "; ").alias("errors"))


@query(
    "pattern_rules",
    """
    SELECT page_id, length(url) <= 500 AS short_enough, array_to_string(CASE WHEN html LIKE '%<table%' THEN ['format'] ELSE [] END, ',') AS format_errors FROM pages
    """,
)
def pattern_rules(t: Tables) -> DataFrame:
    rules = ql.regex_rules("url")
    build_format = F.when(F.col("html").contains("<table"), F.lit("gradle")).otherwise(F.lit("BP"))
    return t.pages.select(
        "page_id",
        rules["pattern length"].alias("short_enough"),
        F.array_join(ql.errors_of({"format": ql.build_format_rule(build_format)}), ",").alias("format_errors"),
    )


@query(
    "admission_rules",
    r"""
    WITH u AS (SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) || CASE WHEN url LIKE '%.html' THEN '.APK' WHEN url LIKE '%/' THEN '.zip'
                 WHEN url LIKE '%#top' THEN '.exe' ELSE '.tar.gz' END AS name,
                 CASE WHEN url LIKE 'https%' THEN 'firmware' WHEN url LIKE '%?%' THEN 'photo' ELSE 'apk' END AS kind, strlen(html) AS size FROM pages)
    SELECT page_id, array_to_string(list_filter([CASE WHEN kind = 'photo' THEN 'type' END,
       CASE WHEN NOT regexp_matches(lower(name), '[.](zip|tar|gz|bz2|md5|lz4|tgz|rar|7z|lzma|xz|ozip|apk)$') THEN 'extension' END,
       CASE WHEN lower(name) LIKE '%.apk' AND kind <> 'apk' THEN 'app type' END], lambda x: x IS NOT NULL), ',') AS errors,
       CASE WHEN size <= 4000 THEN 'pending' ELSE 'failed' END AS gate FROM u
    """,
)
def admission_rules(t: Tables) -> DataFrame:
    from ..operators.scanners import size_gate

    url = F.col("url")
    ending = F.when(url.endswith(".html"), ".APK").when(url.endswith("/"), ".zip").when(url.endswith("#top"), ".exe").otherwise(".tar.gz")
    kind = F.when(url.startswith("https"), "firmware").when(url.contains("?"), "photo").otherwise("apk")
    uploads = t.pages.select(
        "page_id",
        F.concat(F.regexp_extract("url", "://([^/?#]+)", 1), ending).alias("name"),
        kind.alias("kind"),
        F.octet_length("html").alias("size"),
    )
    rules = ql.upload_rules("name", "kind", "size", F.lit(0))
    return uploads.select(
        "page_id", F.array_join(ql.errors_of(rules), ",").alias("errors"), size_gate(F.col("size"), 4000).alias("gate")
    )


@query(
    "size_gate",
    "SELECT doc_id, CASE WHEN strlen(text) <= 2000 THEN 'pending' ELSE 'failed' END AS status FROM documents",
)
def size_gates(t: Tables) -> DataFrame:
    from ..operators.scanners import size_gate

    return t.documents.select("doc_id", size_gate(F.octet_length("text"), 2000).alias("status"))
