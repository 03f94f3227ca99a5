"""File inventory over documents: text is file content, source the firmware, language the partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import any_suffix
from ..functions.digests import checksums, sha512
from ..catalog import IMPORT_EXTENSIONS
from ..operators import inventory as inv
from ..operators.numbering import chunked
from ..operators.scan import keyset_page
from ..operators.snapshots import route
from .registry import Tables, query, sql_text


def files(t: Tables) -> DataFrame:
    return t.documents.select(
        F.col("doc_id").alias("file_id"),
        F.col("source").alias("firmware_id"),
        F.col("lang").alias("partition_name"),
        F.octet_length("text").alias("size"),
        F.md5("text").alias("md5"),
        "text",
    )


@query(
    "dup_content_across_sources",
    """
    SELECT md5(text) AS md5, count(*) AS copies, count(DISTINCT source) AS owners, min(doc_id) AS first_id
    FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1
    """,
)
def dup_content_across_sources(t: Tables) -> DataFrame:
    return inv.duplicate_content(files(t), "md5", "firmware_id", "file_id")


@query(
    "dup_content_groups",
    "SELECT md5(text) AS md5, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def dup_content_groups(t: Tables) -> DataFrame:
    return inv.duplicate_groups(files(t), "md5", "file_id")


@query(
    "checksum_digests",
    "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents",
)
def checksum_digests(t: Tables) -> DataFrame:
    sums = checksums("text")
    return t.documents.select("doc_id", *[c.alias(name) for name, c in sums.items()])


@query("digest_512")
def digest_512(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", sha512("text").alias("sha512"))


def counters(t: Tables) -> DataFrame:
    labelled = files(t).join(t.labels.withColumnRenamed("doc_id", "file_id"), "file_id", "left")
    return inv.partition_counters(
        labelled,
        ["firmware_id", "partition_name"],
        is_app=F.col("quality").isNotNull(),
        is_property_file=F.col("text").rlike(r"\w = \S"),
        success=F.col("quality") == 1,
    )


COUNTERS_SQL = r"""
    SELECT source AS firmware_id, lang AS partition_name, count(*) AS firmware_file_count,
           count(quality) AS android_app_count,
           count(*) FILTER (regexp_matches(text, '\w+ = \S+')) AS build_prop_count,
           sum(strlen(text))::BIGINT AS total_bytes,
           bool_or(coalesce(quality = 1, false)) AS is_import_success
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2
"""


@query("inventory_by_partition", COUNTERS_SQL)
def inventory_by_partition(t: Tables) -> DataFrame:
    return counters(t)


@query(
    "import_accepted",
    f"SELECT firmware_id, bool_or(is_import_success) AS accepted FROM ({COUNTERS_SQL}) c GROUP BY 1",
)
def import_accepted(t: Tables) -> DataFrame:
    return inv.import_accepted(counters(t), "firmware_id")


@query(
    "new_imports_by_hash",
    """
    SELECT doc_id AS file_id, md5(text) AS md5 FROM documents
    WHERE source <> 'src0' AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE source = 'src0')
    """,
)
def new_imports_by_hash(t: Tables) -> DataFrame:
    rows = files(t).select("file_id", "firmware_id", "md5")
    incoming = rows.where("firmware_id <> 'src0'").select("file_id", "md5")
    return inv.new_by_hash(incoming, rows.where("firmware_id = 'src0'"), "md5").select("file_id", "md5")


@query(
    "missing_ids",
    """
    SELECT DISTINCT doc_id * 2 AS doc_id FROM labels
    WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)
    """,
)
def missing_ids(t: Tables) -> DataFrame:
    requested = t.labels.select((F.col("doc_id") * 2).alias("doc_id"))
    return inv.missing_ids(requested, t.documents, "doc_id")


@query(
    "not_yet_scanned",
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def not_yet_scanned(t: Tables) -> DataFrame:
    return inv.not_yet_scanned(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@query(
    "hash_first_match",
    """
    WITH f AS (SELECT md5(text) AS md5, min(doc_id) AS file_id FROM documents
               WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1),
         a AS (SELECT doc_id AS app_id, md5(text) AS md5 FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
    SELECT app_id, f.file_id FROM a LEFT JOIN f USING (md5)
    """,
)
def hash_first_match(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.md5("text").alias("md5"))
    apps = rows.join(t.labels, "doc_id", "left_semi").select(F.col("doc_id").alias("app_id"), "md5")
    others = rows.join(t.labels, "doc_id", "left_anti").select(F.col("doc_id").alias("file_id"), "md5")
    return inv.first_file_by_hash(apps, others, ["md5"], "file_id").select("app_id", "file_id")


@query(
    "hash_all_matches",
    """
    SELECT doc_id AS file_id, md5(text) AS md5 FROM documents
    WHERE md5(text) IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
    """,
)
def hash_all_matches(t: Tables) -> DataFrame:
    rows = files(t).select("file_id", "md5")
    toxic = t.labels.where("toxic = 1").select(F.col("doc_id").alias("file_id"))
    return inv.files_by_hash(rows, rows.join(toxic, "file_id", "left_semi"), "md5")


SIBLING_SQL = r"""
    WITH named AS (
      SELECT page_id, regexp_extract(url, '[.]([a-z]+)/', 1) AS firmware_id,
             regexp_extract(url, '/([a-z][a-z])/([0-9]+)', 1) AS lang,
             regexp_extract(url, '/([a-z][a-z])/([0-9]+)', 2) AS stem,
             CASE WHEN url LIKE '%.html' THEN '.apk' WHEN url LIKE '%?page=%' THEN '.odex'
                  WHEN url LIKE '%?utm%' THEN '.vdex' WHEN url LIKE '%#top' THEN '.art'
                  WHEN url LIKE '%/' THEN '.apk.prof' ELSE '.txt' END AS suffix FROM pages),
    apps AS (SELECT firmware_id, lang, stem, min(page_id) AS app_id FROM named WHERE suffix = '.apk' GROUP BY 1, 2, 3),
    sib AS (SELECT firmware_id, lang, stem, suffix, min(page_id) AS file_id FROM named
            WHERE suffix NOT IN ('.apk', '.txt') GROUP BY 1, 2, 3, 4)
    SELECT app_id, file_id, suffix FROM apps JOIN sib USING (firmware_id, lang, stem)
"""


@query("sibling_match_by_stem", SIBLING_SQL)
def sibling_match_by_stem(t: Tables) -> DataFrame:
    url = F.col("url")
    suffix = (
        F.when(url.endswith(".html"), F.lit(".apk"))
        .when(url.contains("?page="), F.lit(".odex"))
        .when(url.contains("?utm"), F.lit(".vdex"))
        .when(url.endswith("#top"), F.lit(".art"))
        .when(url.endswith("/"), F.lit(".apk.prof"))
        .otherwise(F.lit(".txt"))
    )
    folder = F.regexp_extract("url", "/([a-z][a-z])/([0-9]+)", 1)
    stem = F.regexp_extract("url", "/([a-z][a-z])/([0-9]+)", 2)
    # Optimised files lie in a folder below the app, as on a device.
    below = F.when(suffix == ".apk", F.lit("")).otherwise(F.lit("oat/"))
    rows = t.pages.select(
        "page_id",
        F.regexp_extract("url", "[.]([a-z]+)/", 1).alias("firmware_id"),
        F.concat(F.lit("/"), folder, F.lit("/"), below, stem, suffix).alias("path"),
    )
    rows = rows.groupBy("firmware_id", "path").agg(F.min("page_id").alias("file_id"))
    apps = rows.where(F.col("path").endswith(".apk")).withColumnRenamed("file_id", "app_id")
    return inv.optimised_siblings(apps, rows)


@query(
    "partition_append",
    "SELECT doc_id, source, CASE WHEN lang = 'en' THEN 'archive' ELSE 'firmware' END AS listing FROM documents",
)
def partition_append(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source", "lang")
    listed = inv.listing(rows.where("lang <> 'en'"), rows.where("lang = 'en'"))
    return listed.select("doc_id", "source", "listing")


NOT_SUPPORTED = "File extension of root archive is not supported."
ALREADY_STORED = "Skipped file - Already in database."


@query(
    "quarantine_split",
    f"""
    WITH incoming AS (
      SELECT doc_id, md5(text) AS md5,
             source || CASE lang WHEN 'en' THEN '.zip' WHEN 'fr' THEN '.exe' ELSE '.tar.gz' END AS name
      FROM documents WHERE source <> 'src1')
    SELECT doc_id, reason, reason IS NULL AS admitted FROM (
      SELECT doc_id, CASE WHEN md5 IN (SELECT md5(text) FROM documents WHERE source = 'src1') THEN {sql_text(ALREADY_STORED)}
             WHEN NOT regexp_matches(name, '([.]zip|[.]tar|[.]gz|[.]bz2|[.]md5|[.]lz4|[.]tgz|[.]rar|[.]7z|lzma|[.]xz|[.]ozip)$')
             THEN {sql_text(NOT_SUPPORTED)} END AS reason FROM incoming) r
    """,
)
def quarantine_split(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source", "lang", F.md5("text").alias("md5"))
    ending = F.when(F.col("lang") == "en", ".zip").when(F.col("lang") == "fr", ".exe").otherwise(".tar.gz")
    incoming = rows.where("source <> 'src1'").withColumn("name", F.concat("source", ending))
    stored = rows.where("source = 'src1'").select("md5").distinct().withColumn("stored", F.lit(True))
    marked = incoming.join(stored, "md5", "left")
    routed = route(
        marked,
        {
            ALREADY_STORED: F.coalesce("stored", F.lit(False)),
            NOT_SUPPORTED: ~any_suffix(F.col("name"), IMPORT_EXTENSIONS),
        },
    )
    return routed.select("doc_id", "reason", "admitted")


STORE_SQL = "SELECT c_custkey, c_mktsegment AS store_uuid, s.setting FROM customer JOIN (SELECT c_mktsegment, min(c_nationkey) AS setting FROM customer GROUP BY 1) s USING (c_mktsegment)"


def stored_customers(t: Tables) -> DataFrame:
    """Customers as firmware below a store folder, and one setting per store."""
    path = F.concat(F.lit("/mnt/data/corpus/stores/"), F.col("c_mktsegment"), F.lit("/"), F.col("c_custkey"))
    firmware = t.customer.select("c_custkey", path.alias("path"))
    stores = t.customer.groupBy(F.col("c_mktsegment").alias("store_uuid")).agg(F.min("c_nationkey").alias("setting"))
    return inv.with_store(firmware, stores, "path").select("c_custkey", "store_uuid", "setting")


@query("store_join", STORE_SQL)
def store_join(t: Tables) -> DataFrame:
    return stored_customers(t)


@query(
    "store_bundles",
    f"SELECT store_uuid, count(*) AS firmware, min(c_custkey) AS first_id, max(c_custkey) AS last_id FROM ({STORE_SQL}) b GROUP BY 1",
)
def store_bundles(t: Tables) -> DataFrame:
    return stored_customers(t).groupBy("store_uuid").agg(
        F.count("*").alias("firmware"), F.min("c_custkey").alias("first_id"), F.max("c_custkey").alias("last_id")
    )


@query(
    "id_chunks",
    """
    SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000)::BIGINT AS chunk_no FROM orders
    """,
)
def id_chunks(t: Tables) -> DataFrame:
    return chunked(t.orders.select("o_orderkey"), "o_orderkey", 1000)


@query(
    "keyset_page",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 50",
)
def keyset_orders(t: Tables) -> DataFrame:
    return keyset_page(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", 1000, 50)
