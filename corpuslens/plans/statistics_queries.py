"""Corpus statistics, one query per shape and report."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import MATCH_CATEGORIES, PRIVACY_CATEGORIES, STRING_COUNT_ATTRIBUTES, TOP_VALUES_ROWS
from ..functions.text import entropies, language, text_flags, word_count
from ..operators.numbering import numbered
from ..operators import reports as rp
from ..operators import stats as st
from ..operators.rollups import ACCURACY, QUANTILES, Rollups
from ..session import new_work_dir
from .registry import Tables, query, sql_text
from .text_queries import FLAG_SQL, LANGUAGE_SQL, SECRET_PATTERNS, TRACKERS, secret_sql


@query(
    "atomic_counts",
    """
    SELECT 'o_orderstatus' AS attribute, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2
    UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2
    """,
)
def atomic_counts(t: Tables) -> DataFrame:
    return st.atomic_counts(t.orders, ["o_orderstatus", "o_orderpriority"])


def page_lists() -> dict[str, Column]:
    return {
        "tags": F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), 1),
        "links": F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1),
    }


TAGS_SQL = "regexp_extract_all(html, '<([a-z0-9]+)', 1)"
LINKS_SQL = "regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)"


@query(
    "list_counts",
    f"""
    SELECT attribute, value, count(*) AS n FROM (
      SELECT 'tags' AS attribute, unnest({TAGS_SQL}) AS value FROM pages
      UNION ALL SELECT 'links', unnest({LINKS_SQL}) FROM pages) e GROUP BY 1, 2
    """,
)
def list_counts(t: Tables) -> DataFrame:
    return st.list_counts(t.pages, page_lists())


@query(
    "list_references",
    f"""
    SELECT DISTINCT attribute, value, page_id FROM (
      SELECT 'tags' AS attribute, unnest({TAGS_SQL}) AS value, page_id FROM pages
      UNION ALL SELECT 'links', unnest({LINKS_SQL}), page_id FROM pages) e
    """,
)
def list_references(t: Tables) -> DataFrame:
    return st.list_references(t.pages, page_lists(), "page_id")


@query(
    "boolean_counts",
    f"""
    SELECT 'links' AS attribute, CASE WHEN len({LINKS_SQL}) > 0 THEN 'true' ELSE 'false' END AS value, count(*) AS n FROM pages GROUP BY 2
    UNION ALL SELECT 'tables', CASE WHEN len(regexp_extract_all(html, '<table')) > 0 THEN 'true' ELSE 'false' END, count(*) FROM pages GROUP BY 2
    """,
)
def boolean_counts(t: Tables) -> DataFrame:
    return st.presence_counts(
        t.pages, {"links": page_lists()["links"], "tables": F.regexp_extract_all("html", F.lit("<table"), 0)}
    )


@query(
    "reference_rows",
    """
    SELECT 'o_orderpriority' AS attribute, o_orderpriority AS value, o_orderkey FROM orders
    UNION ALL SELECT 'o_orderstatus', o_orderstatus, o_orderkey FROM orders
    """,
)
def reference_rows(t: Tables) -> DataFrame:
    return st.atomic_references(t.orders, ["o_orderpriority", "o_orderstatus"], "o_orderkey")


@query(
    "cardinality_series",
    """
    SELECT elements, count(*) AS owners FROM (SELECT l_orderkey, count(DISTINCT l_partkey) AS elements FROM lineitem GROUP BY 1) c GROUP BY 1
    """,
)
def cardinality_series(t: Tables) -> DataFrame:
    return st.cardinality_series(st.cardinality(t.lineitem, "l_orderkey", "l_partkey"))


@query(
    "two_level_counts",
    """
    WITH o AS (SELECT l_orderkey, p_type, count(*) AS entries FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
    SELECT p_type, sum(entries)::BIGINT AS entries, count(*) AS owner_levels FROM o GROUP BY ROLLUP (p_type)
    """,
)
def two_level_counts(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_partkey").join(
        t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")
    )
    return st.two_level_counts(lines, "l_orderkey", "p_type")


@query(
    "firmware_totals",
    """
    SELECT count(*) AS row_count, sum(strlen(text))::BIGINT AS byte_total, count(DISTINCT md5(text)) AS unique_md5,
           count(DISTINCT source) AS unique_source FROM documents
    """,
)
def firmware_totals(t: Tables) -> DataFrame:
    rows = t.documents.select(F.octet_length("text").alias("size"), F.md5("text").alias("md5"), "source")
    return st.totals(rows, F.col("size"), {"md5": F.col("md5"), "source": F.col("source")})


@query(
    "numeric_histogram",
    f"""
    WITH ch AS (SELECT doc_id, ch, count(*) AS k FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) c GROUP BY 1, 2),
    e AS (SELECT doc_id, -sum(p * ln(p)) AS h FROM (SELECT doc_id, k / sum(k) OVER (PARTITION BY doc_id) AS p FROM ch) q GROUP BY 1),
    v AS (
      SELECT 'string_length' AS attribute, length(text) AS v, 500.0 AS width FROM documents
      UNION ALL SELECT 'number_of_words_estimate', len(regexp_extract_all(text, '\\S+')), 100.0 FROM documents
      UNION ALL SELECT 'natural_entropy', round(h, 6), 0.05 FROM e
      UNION ALL SELECT 'shannon_entropy', round(h / ln(2), 6), 0.05 FROM e
      UNION ALL SELECT 'hartley_entropy', round(h / ln(10), 6), 0.05 FROM e
      UNION ALL SELECT 'language_confidence', language_confidence, 0.1 FROM ({LANGUAGE_SQL}) l)
    SELECT attribute, floor(round(v / width, 4))::BIGINT AS bucket, count(*) AS n FROM v GROUP BY 1, 2
    """,
)
def numeric_histogram(t: Tables) -> DataFrame:
    """All numeric attributes of a text, each measured once."""
    measured = t.spread("documents", "doc_id").select(
        F.length("text").alias("string_length"), word_count("text").alias("number_of_words_estimate"), entropies("text").alias("e"),
        language("text").alias("l"),
    )
    widths = {"string_length": 500, "number_of_words_estimate": 100}
    columns = {name: (F.col(name) / width, 1) for name, width in widths.items()}
    columns |= {n: (F.round(f"e.{n}", 6) / 0.05, 1) for n in ("natural_entropy", "shannon_entropy", "hartley_entropy")}
    columns["language_confidence"] = (F.round("l.language_confidence", 6) / 0.1, 1)
    return st.histograms(measured, {name: (F.round(value, 4), width) for name, (value, width) in columns.items()})


@query(
    "averages",
    r"""
    SELECT round(avg(len(regexp_extract_all(text, '\S+'))), 6) AS number_of_words_estimate_average,
           round(avg(length(text)), 6) AS string_length_average FROM documents
    """,
)
def averages(t: Tables) -> DataFrame:
    means = st.averages(
        t.documents,
        {"number_of_words_estimate_average": word_count("text"), "string_length_average": F.length("text")},
    )
    return means.select(*[F.round(c, 6).alias(c) for c in means.columns])


@query(
    "scan_status_summary",
    """
    SELECT source, count(*) AS reports, count(*) FILTER (quality = 1) AS completed, count(DISTINCT lang) AS languages,
           count(DISTINCT CASE WHEN toxic = 1 THEN doc_id END) AS affected_apps FROM documents JOIN labels USING (doc_id) GROUP BY 1
    """,
)
def scan_status_summary(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "source", "lang").join(t.labels, "doc_id")
    return joined.groupBy("source").agg(
        F.count("*").alias("reports"),
        F.count_if(F.col("quality") == 1).alias("completed"),
        F.countDistinct("lang").alias("languages"),
        F.countDistinct(F.when(F.col("toxic") == 1, F.col("doc_id"))).alias("affected_apps"),
    )


FLAG_NAMES = [name for name in STRING_COUNT_ATTRIBUTES if name.startswith("is")]


@query(
    "flag_counts",
    f"""
    WITH f AS (SELECT *, NOT (isNumeric OR isURL OR isFilePath OR isSQLStatement OR isEncoded OR isSecret OR isNaturalLanguage) AS isUnknownCategory
               FROM ({FLAG_SQL}) x)
    {" UNION ALL ".join(f"SELECT '{n}' AS attribute, {n}::VARCHAR AS value, count(*) AS n FROM f GROUP BY 2" for n in FLAG_NAMES)}
    UNION ALL SELECT 'language_code', language_code, count(*) FROM ({LANGUAGE_SQL}) l WHERE language_code IS NOT NULL GROUP BY 2
    """,
)
def flag_counts(t: Tables) -> DataFrame:
    """All category flags and the language, in one aggregation."""
    flags = text_flags("text")
    judged = t.spread("documents", "doc_id").select(*[flags[n].alias(n) for n in FLAG_NAMES], language("text")["language_code"].alias("language_code"))
    return st.atomic_counts(judged, [*FLAG_NAMES, "language_code"])


LEAKS_SQL = f"SELECT 'leaks' AS attribute, rule AS value, count(*) AS n FROM ({secret_sql()}) s GROUP BY 2"


@query("leak_counts", LEAKS_SQL)
def leak_counts(t: Tables) -> DataFrame:
    found = rp.pattern_findings(t.spread("documents", "doc_id"), "doc_id", "text", SECRET_PATTERNS)
    return st.atomic_counts(found, {"leaks": F.col("rule")})


@query("leak_references", f"SELECT DISTINCT 'leaks' AS attribute, rule AS value, doc_id FROM ({secret_sql()}) s")
def leak_references(t: Tables) -> DataFrame:
    found = rp.pattern_findings(t.spread("documents", "doc_id"), "doc_id", "text", SECRET_PATTERNS)
    return st.atomic_references(found.select("doc_id", "rule").distinct(), {"leaks": F.col("rule")}, "doc_id")


@query(
    "threat_levels",
    """
    WITH l AS (SELECT l_orderkey, CASE WHEN sum(l_quantity) > 200 THEN 'high' WHEN sum(l_quantity) > 100 THEN 'moderate' ELSE 'low' END AS level
               FROM lineitem GROUP BY 1)
    SELECT 'threat_level' AS attribute, level AS value, count(*) AS n FROM l GROUP BY 2
    """,
)
def threat_levels(t: Tables) -> DataFrame:
    total = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("score"))
    level = F.when(F.col("score") > 200, "high").when(F.col("score") > 100, "moderate").otherwise("low")
    return st.atomic_counts(total, {"threat_level": level})


@query(
    "threat_references",
    """
    SELECT 'threat_level' AS attribute, CASE WHEN sum(l_quantity) > 200 THEN 'high' WHEN sum(l_quantity) > 100 THEN 'moderate' ELSE 'low' END AS value,
      l_orderkey FROM lineitem GROUP BY l_orderkey
    """,
)
def threat_references(t: Tables) -> DataFrame:
    total = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("score"))
    level = F.when(F.col("score") > 200, "high").when(F.col("score") > 100, "moderate").otherwise("low")
    return st.atomic_references(total, {"threat_level": level}, "l_orderkey")


@query(
    "severity_references",
    """
    SELECT DISTINCT CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'critical' END AS attribute, p_type AS value, l_orderkey
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('R', 'A')
    """,
)
def severity_references(t: Tables) -> DataFrame:
    """Which apps have high and critical findings, per category."""
    issues = t.lineitem.where(F.col("l_returnflag").isin("R", "A")).select("l_orderkey", "l_partkey", "l_returnflag").join(
        t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")
    )
    level = F.when(F.col("l_returnflag") == "R", "high").otherwise("critical")
    return issues.select(level.alias("attribute"), F.col("p_type").alias("value"), "l_orderkey").distinct()


@query(
    "severity_counts",
    """
    SELECT p_type AS category, count(*) AS vulnerabilities, count(*) FILTER (l_returnflag = 'R') AS high,
           count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS affected_apps
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
    """,
)
def severity_counts(t: Tables) -> DataFrame:
    issues = t.lineitem.select("l_orderkey", "l_partkey", "l_returnflag").join(
        t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")
    )
    high = F.col("l_returnflag") == "R"
    return issues.groupBy(F.col("p_type").alias("category")).agg(
        F.count("*").alias("vulnerabilities"),
        F.count_if(high).alias("high"),
        F.countDistinct(F.when(high, F.col("l_orderkey"))).alias("affected_apps"),
    )


def listed(names: list[str], key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (key % len(names) + 1).cast("int"))


def listed_sql(names: list[str], key: str) -> str:
    return "[" + ", ".join(sql_text(n) for n in names) + f"][({key} % {len(names)} + 1)::INT]"


@query(
    "category_matches",
    f"""
    SELECT {listed_sql(MATCH_CATEGORIES, "user_id")} AS attribute, event_type AS value, count(*) AS n FROM events GROUP BY 1, 2
    """,
)
def category_matches(t: Tables) -> DataFrame:
    payload = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.col("event_type").alias("filename"),
                    F.create_map(listed(MATCH_CATEGORIES, F.col("user_id")), F.array("event_type")).alias("matches"),
                )
            ).alias("files")
        )
    )
    found = rp.match_findings(t.events.select("event_id", payload.alias("results")), "event_id", "results")
    return found.groupBy(F.col("category").alias("attribute"), F.col("match").alias("value")).agg(F.count("*").alias("n"))


@query(
    "privacy_categories",
    f"""
    SELECT {listed_sql(PRIVACY_CATEGORIES, "user_id")} AS attribute, event_type AS value, count(*) AS n FROM events GROUP BY 1, 2
    """,
)
def privacy_categories(t: Tables) -> DataFrame:
    pairs = F.create_map(listed(PRIVACY_CATEGORIES, F.col("user_id")), F.array("event_type"))
    columns = {name: pairs[name] for name in PRIVACY_CATEGORIES}
    return st.list_counts(t.events.select("event_type", "user_id"), columns)


@query(
    "detection_categories",
    "SELECT 'detection_category' AS attribute, event_type AS value, count(*) AS n FROM events GROUP BY 2",
)
def detection_categories(t: Tables) -> DataFrame:
    return st.atomic_counts(t.events, {"detection_category": F.col("event_type")})


@query(
    "detection_references",
    "SELECT DISTINCT 'detection_category' AS attribute, event_type AS value, user_id FROM events WHERE event_type IS NOT NULL",
)
def detection_references(t: Tables) -> DataFrame:
    found = t.events.select("user_id", "event_type").distinct()
    return st.atomic_references(found, {"detection_category": F.col("event_type")}, "user_id")


@query(
    "top_values",
    """
    WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)
    (SELECT 'l_partkey' AS attribute, l_partkey::VARCHAR AS value, n FROM c ORDER BY n DESC, value LIMIT 20)
    UNION ALL (SELECT 'l_suppkey', l_suppkey::VARCHAR AS value, n FROM s ORDER BY n DESC, value LIMIT 20)
    """,
)
def top_values(t: Tables) -> DataFrame:
    counts = st.atomic_counts(t.lineitem, ["l_partkey", "l_suppkey"])
    return st.top_values(counts, ["l_partkey", "l_suppkey"], rows=20)


@query(
    "size_guard",
    """
    SELECT attribute, count(*) AS "values", count(*) > 10000 AS over_limit FROM (SELECT DISTINCT 'l_suppkey' AS attribute, l_suppkey AS v FROM lineitem
      UNION ALL SELECT DISTINCT 'l_orderkey', l_orderkey FROM lineitem) d GROUP BY 1
    """,
)
def size_guard(t: Tables) -> DataFrame:
    return st.attributes_within(st.atomic_counts(t.lineitem, ["l_suppkey", "l_orderkey"]), TOP_VALUES_ROWS)


@query(
    "tracker_counts",
    f"""
    WITH h AS (SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages),
    s(tracker, domain) AS (VALUES {", ".join(f"({sql_text(k)}, {sql_text(d)})" for k, d in TRACKERS.items())}),
    m AS (SELECT DISTINCT page_id, tracker FROM h JOIN s ON host = domain OR host LIKE '%.' || domain)
    SELECT tracker, count(*) AS apps FROM m GROUP BY 1
    UNION ALL SELECT 'none', count(*) FROM pages WHERE page_id NOT IN (SELECT page_id FROM m)
    """,
)
def tracker_counts(t: Tables) -> DataFrame:
    signatures = t.spark.createDataFrame(list(TRACKERS.items()), "tracker string, domain string")
    hosts = t.pages.select("page_id", F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"))
    found = rp.detect_trackers(hosts, signatures, "page_id", "host")
    per_page = hosts.select("page_id").join(found, "page_id", "left")
    return per_page.groupBy(F.coalesce("tracker", F.lit("none")).alias("tracker")).agg(F.count("*").alias("apps"))


ROLLED = ["cents", "o_orderkey"]


def _rollups(t: Tables) -> Rollups:
    """Orders by status and day, one owner added after the other, one of them twice."""
    rollups = Rollups(t.spark, new_work_dir(t.spark, "rollups"), numeric=ROLLED, distinct=["o_custkey", "o_orderkey"])
    orders = t.orders.withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    for status in ("F", "O", "P", "O"):
        rollups.add(orders.where(F.col("o_orderstatus") == status), "o_orderstatus", "o_orderdate")
    return rollups


@query(
    "rollup_totals",
    """
    WITH o AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders WHERE o_orderstatus IN ('F', 'O', 'P'))
    SELECT o_orderstatus AS owner, 'cents' AS attribute, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total, min(cents) AS lowest, max(cents) AS highest FROM o GROUP BY 1
    UNION ALL SELECT o_orderstatus, 'o_orderkey', count(*), CAST(sum(o_orderkey) AS BIGINT), min(o_orderkey), max(o_orderkey) FROM o GROUP BY 1
    """,
)
def rollup_totals(t: Tables) -> DataFrame:
    exact = [F.col(c).cast("long").alias(c) for c in ("total", "lowest", "highest")]
    return _rollups(t).totals(by=["owner"]).select("owner", "attribute", "n", *exact)


@query(
    "rollup_estimates",
    """
    SELECT 'cents' AS attribute, unnest([0.5, 0.9, 0.99])::DOUBLE AS share, true AS within
    UNION ALL SELECT 'o_orderkey', unnest([0.5, 0.9, 0.99])::DOUBLE, true
    UNION ALL SELECT unnest(['o_custkey', 'o_orderkey']), NULL, true
    """,
)
def rollup_estimates(t: Tables) -> DataFrame:
    """Whether merged quantiles and distinct counts are as near to the exact ones as they promise."""
    rollups = _rollups(t)
    orders = t.orders.where("o_orderstatus IN ('F', 'O', 'P')").withColumn("cents", F.round(F.col("o_totalprice") * 100))
    exact = None
    for name in ROLLED:
        # The smallest value at or below which a share of the rows lies: rows are numbered in order, over all tasks.
        known = orders.where(F.col(name).isNotNull())
        ranked = numbered(known.select(F.col(name).alias("exact"), F.col("o_orderkey").alias("_key")), ["exact", "_key"], "place")
        places = known.agg(F.count("*").alias("n")).select(F.inline(F.array(*[
            F.struct(F.lit(s).alias("share"), F.greatest(F.ceil(F.col("n") * F.lit(Decimal(str(s)))).cast("long") - 1, F.lit(0)).alias("place")) for s in QUANTILES
        ])))
        one = ranked.join(places, "place").select(F.lit(name).alias("attribute"), "share", F.col("exact").cast("double").alias("exact"))
        exact = one if exact is None else exact.unionByName(one)
    near = F.abs(F.col("value") - F.col("exact")) <= F.col("exact") * (ACCURACY + 1e-9)
    quantiles = rollups.quantiles().join(exact, ["attribute", "share"]).select("attribute", "share", near.alias("within"))
    counts = orders.agg(*[F.countDistinct(c).alias(c) for c in ("o_custkey", "o_orderkey")]).unpivot([], ["o_custkey", "o_orderkey"], "attribute", "exact")
    off = F.abs(F.col("distinct_values") - F.col("exact")) <= F.col("exact") * 0.05
    distinct = rollups.distinct_counts().join(counts, "attribute").select("attribute", F.lit(None).cast("double").alias("share"), off.alias("within"))
    return quantiles.unionByName(distinct)
