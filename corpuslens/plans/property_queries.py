"""Property maps and detection, over page URLs and suppliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import VENDOR_NAMES
from ..functions import string_array
from ..functions.documents import storable_key, storable_map
from ..functions.properties import (
    first_of_keys,
    major_version,
    parse_properties,
    vendor_of_value,
)
from ..functions.text import sanitise_identity, sanitise_text
from ..operators import properties as pr
from ..operators.scan import has_all_keys, has_any_value
from ..operators.stats import atomic_counts
from .registry import Tables, query, sql_text, sql_values


def query_part() -> Column:
    return F.regexp_extract("url", r"\?([^#]*)", 1)


def host() -> Column:
    return F.regexp_extract("url", "://([^/?#]+)", 1)


def page_properties(t: Tables) -> DataFrame:
    """The query part of each page address as a property map."""
    return t.pages.where(query_part() != "").select(
        "page_id", parse_properties(F.split(query_part(), "&")).alias("properties")
    )


@query("map_keys_exist", "SELECT page_id FROM pages WHERE url LIKE '%?page=%&ref=%'")
def map_keys_exist(t: Tables) -> DataFrame:
    return page_properties(t).where(has_all_keys("properties", ["page", "ref"])).select("page_id")


@query("map_value_any", "SELECT page_id FROM pages WHERE url LIKE '%=feed' OR url LIKE '%=x'")
def map_value_any(t: Tables) -> DataFrame:
    return page_properties(t).where(has_any_value("properties", ["feed", "x"])).select("page_id")


@query(
    "map_keys_values",
    r"""
    WITH p AS (SELECT page_id, string_split(regexp_extract(url, '\?([^#]*)', 1), '&') AS parts FROM pages WHERE url LIKE '%?%')
    SELECT page_id, array_to_string(list_sort(list_transform(parts, lambda x: string_split(x, '=')[1])), ',') AS keys,
           array_to_string(list_sort(list_transform(parts, lambda x: string_split(x, '=')[2])), ',') AS "values" FROM p
    """,
)
def map_keys_values(t: Tables) -> DataFrame:
    return page_properties(t).select(
        "page_id",
        F.array_join(F.array_sort(F.map_keys("properties")), ",").alias("keys"),
        F.array_join(F.array_sort(F.map_values("properties")), ",").alias("values"),
    )


def host_lines(t: Tables) -> DataFrame:
    """Query parts as the lines of one property file per host, in page order."""
    return t.pages.where(query_part() != "").select(
        host().alias("file_id"), F.col("page_id").alias("line_no"), F.explode(F.split(query_part(), "&")).alias("line")
    )


LAST_SQL = r"""
    WITH l AS (SELECT regexp_extract(url, '://([^/?#]+)', 1) AS file_id, page_id,
                      unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) AS line FROM pages WHERE url LIKE '%?%')
    SELECT file_id, string_split(line, '=')[1] AS key, arg_max(string_split(line, '=')[2], page_id) AS value
    FROM l GROUP BY 1, 2
"""


@query("property_last_wins", LAST_SQL)
def property_last_wins(t: Tables) -> DataFrame:
    return pr.last_value_per_key(pr.property_rows(host_lines(t)), "file_id", "line_no")


@query(
    "property_maps",
    f"SELECT file_id, string_agg(key || '=' || value, ',' ORDER BY key) AS properties FROM ({LAST_SQL}) m GROUP BY 1",
)
def property_maps(t: Tables) -> DataFrame:
    maps = pr.property_maps(pr.property_rows(host_lines(t)), "file_id", "line_no")
    entries = F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return maps.select("file_id", F.array_join(F.array_sort(entries), ",").alias("properties"))


# --- vendor and version --------------------------------------------------------------------

MAKERS = [
    "samsung", "LG Electronics", "SomeUnknownVendor", "unknown", "Xiaomi Inc.", "google/redfin/redfin:11",
    "", "HMD Global", "Cat Phones", " Unknown ", "Barnes & Noble", "Sony Mobile Communications",
]
MAKER_COUNT = len(MAKERS)


def maker(shift: int):
    return F.element_at(string_array(MAKERS), ((F.col("s_suppkey") + shift) % MAKER_COUNT + 1).cast("int"))


def maker_sql(shift: int) -> str:
    return "[" + ", ".join(sql_text(m) for m in MAKERS) + f"][((s_suppkey + {shift}) % {MAKER_COUNT} + 1)::INT]"


def supplier_files(t: Tables) -> DataFrame:
    """One property file per supplier, the nation being the firmware."""
    return t.supplier.select(
        F.col("s_nationkey").alias("firmware_id"),
        F.col("s_suppkey").alias("ordinal"),
        F.create_map(
            F.lit("ro_product_manufacturer"), maker(0), F.lit("ro_build_fingerprint"), maker(5)
        ).alias("properties"),
    )


# Vendor of a text: exact, then the first contained key. Raw texts count for the manufacturer only.
VENDOR_CTE = f"""
    vendors(ord, key, vendor) AS (VALUES {sql_values([(i, k, v) for i, (k, v) in enumerate(VENDOR_NAMES.items())])}),
    texts AS (SELECT DISTINCT unnest([{maker_sql(0)}, {maker_sql(5)}]) AS text FROM supplier),
    known AS (SELECT text, coalesce(
        (SELECT any_value(vendor) FROM vendors WHERE key = lower(trim(text))),
        (SELECT arg_min(vendor, ord) FROM vendors WHERE contains(lower(trim(text)), key))) AS vendor
        FROM texts WHERE text <> ''),
    named AS (SELECT s_suppkey, s_nationkey, coalesce(m.vendor,
        CASE WHEN trim({maker_sql(0)}) <> '' AND lower(trim({maker_sql(0)})) <> 'unknown' THEN trim({maker_sql(0)}) END,
        f.vendor) AS vendor
        FROM supplier LEFT JOIN known m ON m.text = {maker_sql(0)} LEFT JOIN known f ON f.text = {maker_sql(5)})
"""


@query(
    "vendor_detect",
    f"""
    WITH {VENDOR_CTE}
    SELECT s_nationkey AS firmware_id,
           coalesce(arg_min(vendor, s_suppkey) FILTER (vendor IS NOT NULL), 'Unknown') AS os_vendor
    FROM named GROUP BY 1
    """,
)
def vendor_detect(t: Tables) -> DataFrame:
    return pr.detect_vendors(supplier_files(t), "firmware_id", "ordinal")


@query(
    "vendor_normalise",
    f"WITH {VENDOR_CTE} SELECT s_suppkey, vendor FROM named",
)
def vendor_normalise(t: Tables) -> DataFrame:
    return t.supplier.select(
        "s_suppkey", F.coalesce(vendor_of_value(maker(0), True), vendor_of_value(maker(5), False)).alias("vendor")
    )


@query(
    "counts_by_vendor",
    f"""
    WITH {VENDOR_CTE},
    d AS (SELECT s_nationkey, coalesce(arg_min(vendor, s_suppkey) FILTER (vendor IS NOT NULL), 'Unknown') AS value
          FROM named GROUP BY 1)
    SELECT 'os_vendor' AS attribute, value, count(*) AS n FROM d GROUP BY 2
    """,
)
def counts_by_vendor(t: Tables) -> DataFrame:
    return atomic_counts(pr.detect_vendors(supplier_files(t), "firmware_id", "ordinal"), ["os_vendor"])


@query(
    "firmware_counts",
    f"""
    WITH s AS (SELECT nullif({maker_sql(0)}, '') AS manufacturer, nullif({maker_sql(3)}, '') AS brand FROM supplier)
    SELECT 'manufacturer' AS attribute, manufacturer AS value, count(*) AS n FROM s WHERE manufacturer IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'brand', brand, count(*) FROM s WHERE brand IS NOT NULL GROUP BY 2
    """,
)
def firmware_counts(t: Tables) -> DataFrame:
    properties = F.create_map(F.lit("ro_product_odm_manufacturer"), maker(0), F.lit("ro_product_brand"), maker(3))
    from ..catalog import BRAND_KEYS, MANUFACTURER_KEYS

    rows = t.supplier.select(properties.alias("properties"))
    return atomic_counts(
        rows,
        {
            "manufacturer": first_of_keys("properties", MANUFACTURER_KEYS),
            "brand": first_of_keys("properties", BRAND_KEYS),
        },
    )


@query(
    "vendor_update",
    f"""
    WITH {VENDOR_CTE},
    f AS (SELECT s_suppkey, CASE WHEN s_acctbal < 5000 THEN 'Unknown' ELSE 'Samsung' END AS os_vendor, vendor
          FROM supplier JOIN named USING (s_suppkey))
    SELECT s_suppkey, CASE WHEN os_vendor = 'Unknown' AND vendor IS NOT NULL THEN vendor ELSE os_vendor END AS os_vendor,
           os_vendor = 'Unknown' AND vendor IS NOT NULL AS updated FROM f
    """,
)
def vendor_update(t: Tables) -> DataFrame:
    firmware = t.supplier.select(
        "s_suppkey", F.when(F.col("s_acctbal") < 5000, "Unknown").otherwise("Samsung").alias("os_vendor")
    )
    own = supplier_files(t).select(F.col("ordinal").alias("s_suppkey"), "ordinal", "properties")
    detected = pr.detect_vendors(own, "s_suppkey", "ordinal")
    return pr.update_vendors(firmware, detected, "s_suppkey", F.col("os_vendor") == "Unknown")


def release() -> Column:
    return (
        F.when(F.col("url").endswith("#top"), F.lit("Tiramisu"))
        .when(F.col("url").endswith("/"), F.lit(""))
        .otherwise(F.regexp_extract("url", "/[a-z][a-z]/([^?#/]*)", 1))
    )


RELEASE_SQL = """CASE WHEN url LIKE '%#top' THEN 'Tiramisu' WHEN url LIKE '%/' THEN ''
    ELSE regexp_extract(url, '/[a-z][a-z]/([^?#/]*)', 1) END"""


@query(
    "version_detect",
    f"""
    WITH v AS (SELECT regexp_extract(url, '://([^/?#]+)', 1) AS firmware_id, page_id, {RELEASE_SQL} AS release FROM pages)
    SELECT firmware_id, coalesce(arg_max(coalesce(try_cast(string_split(release, '.')[1] AS INT), 0), page_id)
           FILTER (release <> ''), 0) AS version_detected FROM v GROUP BY 1
    """,
)
def version_detect(t: Tables) -> DataFrame:
    rows = t.pages.select(
        host().alias("firmware_id"),
        F.col("page_id").alias("ordinal"),
        F.create_map(F.lit("ro_build_version_release"), release()).alias("properties"),
    )
    return pr.detect_versions(rows, "firmware_id", "ordinal")


@query(
    "major_version",
    f"SELECT page_id, try_cast(string_split({RELEASE_SQL}, '.')[1] AS INT) AS major FROM pages",
)
def major_versions(t: Tables) -> DataFrame:
    return t.pages.select("page_id", major_version(release()).alias("major"))


@query(
    "first_of_keys",
    r"""
    SELECT page_id, coalesce(nullif(regexp_extract(url, 'utm_source=([^&#]*)', 1), ''),
                             nullif(regexp_extract(url, 'ref=([^&#]*)', 1), '')) AS value FROM pages WHERE url LIKE '%?%'
    """,
)
def first_of_key_list(t: Tables) -> DataFrame:
    return page_properties(t).select("page_id", first_of_keys("properties", ["utm_source", "ref", "none"]).alias("value"))


@query(
    "sanitise_text",
    r"SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9\[\],\-_]', '', 'g') AS clean, lower(trim(' ' || upper(url) || ' ')) AS identity FROM pages",
)
def sanitised(t: Tables) -> DataFrame:
    padded = F.concat(F.lit(" "), F.upper("url"), F.lit(" "))
    return t.pages.select("page_id", sanitise_text("url").alias("clean"), sanitise_identity(padded).alias("identity"))


@query(
    "key_sanitise",
    r"""
    SELECT page_id, regexp_replace('??' || '?' || h, '[.]', '???', 'g') AS key, u AS value FROM
      (SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS h, url AS u FROM pages)
    """,
)
def key_sanitise(t: Tables) -> DataFrame:
    nested = F.create_map(F.lit("top"), F.create_map(F.concat(F.lit("$$"), host()), F.col("url")))
    rows = t.pages.select("page_id", storable_map(nested, depth=2)["top"].alias("inner"))
    return rows.select("page_id", F.explode("inner").alias("key", "value"))
