"""File names, paths and build descriptors, over parts and page addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import (
    APP_BP_TEMPLATE,
    APP_FORMAT_PATTERNS,
    APP_MK_TEMPLATE,
    DEFAULT_APPS,
    LIBRARY_MK_TEMPLATE,
    SINGLETON_APPS,
)
from ..functions import build as bd
from ..functions import unfold
from ..functions import paths as pt
from ..operators import classify as cl
from ..sources.sinks import export_folder
from .registry import ORACLES, Tables, query, sql_text

# Part type and size give each part a file name and a place.
TYPE_STEMS = {
    "STANDARD": "system", "ECONOMY": "vendor", "SMALL": "product", "MEDIUM": "super", "LARGE": "odm", "PROMO": "build",
}
SIZE_ENDINGS = [".img", "_other.img", "_ext.img", ".img.ext4", ".prop", "_patch.img", ".APK", "_extract.img"]


def part_file_name() -> Column:
    stem = F.lit("")
    for kind, text in TYPE_STEMS.items():
        stem = F.when(F.col("p_type") == kind, F.lit(text)).otherwise(stem)
    ending = F.element_at(F.array(*[F.lit(e) for e in SIZE_ENDINGS]), F.col("p_size") % len(SIZE_ENDINGS) + 1)
    return F.concat(stem, ending)


PART_NAME_SQL = (
    "CASE p_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_STEMS.items())
    + " ELSE '' END || ["
    + ", ".join(sql_text(e) for e in SIZE_ENDINGS)
    + f"][p_size % {len(SIZE_ENDINGS)} + 1]"
)


def part_files(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("file_id"),
        F.col("p_brand").alias("firmware_id"),
        part_file_name().alias("name"),
        (F.col("p_retailprice") > 1900).alias("is_directory"),
    )


FILES_CTE = f"files AS (SELECT p_partkey AS file_id, p_brand AS firmware_id, {PART_NAME_SQL} AS name, p_retailprice > 1900 AS is_directory FROM part)"
IMAGE_TAIL = "(img|rfs|bin|img.ext4|ext4.img)$"


def _image_sql(label: str, condition: str) -> str:
    return f"SELECT file_id, name, '{label}' AS label FROM eligible WHERE {condition}"


@query(
    "partition_classify",
    f"""
    WITH {FILES_CTE},
    eligible AS (SELECT file_id, name, lower(name) AS l FROM files
                 WHERE NOT is_directory AND name NOT LIKE '._%' AND name NOT LIKE '%vbmeta%' AND name NOT LIKE '%patch%')
    """
    + " UNION ALL ".join(
        [
            _image_sql("super", "regexp_matches(l, 'super[.]img|^super[.].*[.]img$|super.*img_sparsechunk$|super[.]*(img|rfs|bin|img.ext4|ext4.img)$')"),
            _image_sql(
                "system",
                "regexp_matches(l, 'system[.]img|^system[.].*[.]img$|system.*img_sparsechunk$|system.*(img|rfs|img.ext4|ext4.img)$') "
                "AND l NOT LIKE '%system_other%' AND l NOT LIKE '%system_ext%'",
            ),
            *[
                _image_sql(label, f"regexp_matches(l, '{label}[.]img|{label}[.]*{IMAGE_TAIL}')")
                for label in ("system_other", "system_ext", "vendor", "oem", "odm", "userdata", "pvmfw", "product")
            ],
            _image_sql("super_empty", "l LIKE '%super_empty.img%'"),
            _image_sql("custom_ext", "regexp_matches(l, '_ext[.](img|rfs|bin|img[.]ext4|ext4[.]img)$') AND l NOT LIKE 'system_ext.%'"),
        ]
    ),
)
def partition_classify(t: Tables) -> DataFrame:
    labels = cl.image_labels("name", F.col("is_directory"))
    return unfold(part_files(t), ["file_id", "name"], labels, "label")


@query("pattern_table_classify", ORACLES["partition_classify"])
def pattern_table_classify(t: Tables) -> DataFrame:
    """The same labels from a table of patterns, which may be of any size."""
    return cl.labelled_images(part_files(t), "file_id", "name", F.col("is_directory"), cl.image_pattern_table(t.spark))


WANTED = ["^system[.]img$", "^vendor[.]img", "^super", "[.]img$"]


@query(
    "pattern_priority_match",
    f"""
    WITH {FILES_CTE},
    r AS (SELECT firmware_id, file_id, CASE WHEN regexp_matches(name, '{WANTED[0]}') THEN 1 WHEN regexp_matches(name, '{WANTED[1]}') THEN 2
          WHEN regexp_matches(name, '{WANTED[2]}') THEN 3 WHEN regexp_matches(name, '{WANTED[3]}') THEN 4 END AS pattern_no FROM files)
    SELECT firmware_id, pattern_no, file_id FROM (SELECT *, row_number() OVER (PARTITION BY firmware_id ORDER BY pattern_no, file_id) AS k
          FROM r WHERE pattern_no IS NOT NULL) x WHERE k = 1
    """,
)
def pattern_priority_match(t: Tables) -> DataFrame:
    return cl.best_match_per_owner(part_files(t), "firmware_id", "name", "file_id", WANTED)


@query(
    "regex_export",
    f"""
    WITH {FILES_CTE}
    SELECT file_id, regexp_replace(firmware_id || '/root/x_dir/app/', '/+', '/', 'g') AS folder FROM files
    WHERE NOT is_directory AND regexp_matches(name, '(?i)[.](apk|img)$') AND name NOT LIKE '%\\_extract%' ESCAPE '\\'
    """,
)
def regex_export(t: Tables) -> DataFrame:
    chosen = part_files(t).where(cl.exportable("name", F.col("is_directory"), "[.](apk|img)$"))
    relative = F.concat(F.lit("/x_dir/a_extract/app/"), F.col("name"))
    return chosen.select("file_id", export_folder(F.col("firmware_id"), F.lit("/"), relative, F.col("name")).alias("folder"))


@query(
    "any_pattern_filter",
    f"WITH {FILES_CTE} SELECT file_id FROM files WHERE regexp_matches(name, '^(?:build|super[.]img)')",
)
def any_pattern_filter(t: Tables) -> DataFrame:
    return part_files(t).where(cl.matches_at_start("name", ["build", "super[.]img"])).select("file_id")


@query(
    "suffix_filter",
    f"""
    WITH {FILES_CTE}
    SELECT file_id, CASE WHEN lower(name) LIKE '%.apk' THEN 'app' WHEN regexp_matches(lower(name), 'build[.]prop|default[.]prop')
           THEN 'property' ELSE 'other' END AS kind, regexp_matches(name, '[.](apk|odex|dex|vdex|art|aab)$') AS app_format FROM files
    """,
)
def suffix_filter(t: Tables) -> DataFrame:
    kind = F.when(cl.is_app_file("name"), "app").when(cl.is_property_file("name"), "property").otherwise("other")
    return part_files(t).select("file_id", kind.alias("kind"), cl.matches_at_start("name", APP_FORMAT_PATTERNS).alias("app_format"))


# --- overrides -----------------------------------------------------------------------------


@query(
    "override_lookup",
    """
    WITH m AS (SELECT 'lib' || n_name AS module, n_nationkey AS ord FROM nation),
    s AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN n_name WHEN 1 THEN 'LIB' || n_name ELSE 'x' || n_name END AS module
          FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT s_suppkey, coalesce((SELECT m.module FROM m WHERE lower(m.module) = lower(s.module) OR lower(replace(m.module, 'lib', '')) = lower(s.module)), '') AS override FROM s
    """,
)
def override_lookup(t: Tables) -> DataFrame:
    modules = t.nation.select(F.concat(F.lit("lib"), F.col("n_name")).alias("module"), F.col("n_nationkey").alias("ord"))
    prefix = F.element_at(F.array(F.lit(""), F.lit("LIB"), F.lit("x")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    files = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.concat(prefix, F.col("n_name")).alias("file_module")
    )
    return cl.with_override(files, "file_module", cl.module_variants(modules, "module", "ord")).select("s_suppkey", "override")


OVERRIDE_FORMS = ["MySystemUIGoogle", "Google Camera2 app", "SettingsOverlay", "BluetoothExt", "Tag", "TagX", "NfcNci-one"]


@query(
    "override_words",
    f"""
    WITH d AS (SELECT p_partkey, [{", ".join(sql_text(f) for f in OVERRIDE_FORMS)}][(p_partkey % {len(OVERRIDE_FORMS)} + 1)::INT] || ' ' || p_name AS dir FROM part)
    SELECT p_partkey, CASE WHEN contains(dir, 'Overlay') THEN '' ELSE coalesce(
      list_filter([{", ".join(sql_text(s) for s in SINGLETON_APPS)}], lambda s: contains(dir, s))[1],
      list_filter([{", ".join(sql_text(s) for s in dict.fromkeys(DEFAULT_APPS))}], lambda s: regexp_matches(dir, '\\b' || s || '\\b'))[1], '') END AS override FROM d
    """,
)
def override_words(t: Tables) -> DataFrame:
    form = F.element_at(
        F.array(*[F.lit(f) for f in OVERRIDE_FORMS]), (F.col("p_partkey") % len(OVERRIDE_FORMS) + 1).cast("int")
    )
    return t.part.select("p_partkey", cl.app_override(F.concat_ws(" ", form, F.col("p_name"))).alias("override"))


# --- build descriptors ---------------------------------------------------------------------


@query(
    "sanitised_names",
    "SELECT p_partkey, translate(p_name || '-' || p_brand || '@1.0.so', '.@- ', '____') || '_prebuilt' AS module FROM part",
)
def sanitised_names(t: Tables) -> DataFrame:
    name = F.concat(F.col("p_name"), F.lit("-"), F.col("p_brand"), F.lit("@1.0.so"))
    return t.part.select("p_partkey", bd.module_name(name).alias("module"))


USER_IDS = ["android.uid.shared", "android.media", "android.uid.bluetooth", "android.networkstack", "android.uid.system", None]


@query(
    "signing_case",
    """
    SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'shared' WHEN 1 THEN 'media' WHEN 2 THEN 'bluetooth' WHEN 3 THEN 'networkstack'
      ELSE CASE WHEN p_type = 'SMALL' THEN 'networkstack' ELSE 'platform' END END AS signing_key FROM part
    """,
)
def signing_case(t: Tables) -> DataFrame:
    user = F.element_at(F.array(*[F.lit(u) for u in USER_IDS]), (F.col("p_partkey") % len(USER_IDS) + 1).cast("int"))
    package = F.when(F.col("p_type") == "SMALL", "com.example.cellbroadcast.app").otherwise("com.example.app")
    return t.part.select("p_partkey", bd.signing_key(user, package).alias("signing_key"))


GROUPS = ["/", "Vendor_a", "my_oem", "odm", "product", "SYSTEM_EXT", "system"]


@query(
    "meta_group",
    f"""
    SELECT p_partkey, ['system', 'vendor', 'vendor', 'vendor', 'product', 'system_ext', 'system'][(p_partkey % {len(GROUPS)} + 1)::INT] AS meta_group FROM part
    """,
)
def meta_groups(t: Tables) -> DataFrame:
    partition = F.element_at(F.array(*[F.lit(g) for g in GROUPS]), (F.col("p_partkey") % len(GROUPS) + 1).cast("int"))
    return t.part.select("p_partkey", bd.meta_group(partition).alias("meta_group"))


PLACES = [
    "/system/priv-app/X/", "/vendor/overlay/", "/odm/app/", "/oem/app/", "/a_apex/app/", "/system/app/", "/system/a_extract/lib/x/",
]


def app_path() -> Column:
    place = F.element_at(F.array(*[F.lit(p) for p in PLACES]), (F.col("p_partkey") % len(PLACES) + 1).cast("int"))
    return F.concat(F.lit("/store"), place, F.col("p_name"), F.lit(".apk"))


@query(
    "install_path",
    f"""
    SELECT p_partkey, ['$(TARGET_OUT)/priv-app/', '$(TARGET_OUT)/odm/overlay/', '$(TARGET_OUT)/odm/overlay/', '$(TARGET_OUT)/odm/app/',
      '$(TARGET_OUT)/app/', '$(TARGET_OUT)/app/', '$(TARGET_OUT)/lib/x'][(p_partkey % {len(PLACES)} + 1)::INT] AS install_path FROM part
    """,
)
def install_path(t: Tables) -> DataFrame:
    file_name = F.concat(F.col("p_name"), F.lit(".apk"))
    return t.part.select("p_partkey", bd.app_install_path(app_path(), F.lit("system"), file_name).alias("install_path"))


@query(
    "library_paths",
    """
    SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN '$(TARGET_OUT)/app/' || p_name || '/lib/x//lib/$(TARGET_ARCH_ABI)/'
       WHEN p_type = 'LARGE' THEN '$(TARGET_OUT)/lib64/hw' ELSE '$(TARGET_OUT)/' END AS local_path FROM part
    """,
)
def library_paths(t: Tables) -> DataFrame:
    folder = (
        F.when(F.col("p_type") == "SMALL", F.concat(F.lit("/store/system/app/"), F.col("p_name"), F.lit("/lib/x/")))
        .when(F.col("p_type") == "LARGE", F.lit("/store/system/lib64/hw/"))
        .otherwise(F.lit("/store/system/lib/"))
    )
    path = F.concat(folder, F.lit("f.so"))
    return t.part.select("p_partkey", bd.library_install_path(path, F.lit("system"), F.lit("f.so")).alias("local_path"))


@query(
    "template_render",
    """
    SELECT p_partkey, md5('LOCAL_PATH := $(call my-dir)' || chr(10) || chr(10) || 'include $(CLEAR_VARS)' || chr(10) || chr(10) || 'LOCAL_MODULE_TAGS := optional ' || chr(10)
      || chr(10) || 'LOCAL_MODULE := ' || p_name || chr(10) || chr(10) || 'LOCAL_MODULE_PATH := /x/' || chr(10) || chr(10) || 'LOCAL_CERTIFICATE := platform' || chr(10)
      || chr(10) || 'LOCAL_SRC_FILES := ' || p_name || '.apk' || chr(10) || chr(10) || 'LOCAL_MODULE_CLASS := APPS' || chr(10)
      || chr(10) || 'LOCAL_MODULE_SUFFIX := $(COMMON_ANDROID_PACKAGE_SUFFIX)' || chr(10) || chr(10) || 'LOCAL_OPTIONAL_USES_LIBRARIES := ' || chr(10)
      || chr(10) || 'LOCAL_ENFORCE_USES_LIBRARIES := false' || chr(10) || chr(10) || 'LOCAL_DEX_PREOPT := false' || chr(10)
      || chr(10) || 'LOCAL_PRIVILEGED_MODULE := false' || chr(10) || chr(10) || 'LOCAL_MODULE_RELATIVE_PATH := ' || chr(10)
      || chr(10) || 'LOCAL_OVERRIDES_PACKAGES := ' || p_name || chr(10) || chr(10) || 'include $(BUILD_PREBUILT)' || chr(10)) AS descriptor_md5,
      p_size > 25 AS is_large FROM part
    """,
)
def template_render(t: Tables) -> DataFrame:
    values = {
        "local_module": F.col("p_name"),
        "local_module_path": F.lit("/x/"),
        "local_certificate": F.lit("platform"),
        "local_src_files": F.concat(F.col("p_name"), F.lit(".apk")),
        "local_optional_uses_libraries": F.lit(""),
        "local_enforce_uses_libraries": F.lit("false"),
        "local_dex_preopt": F.lit("false"),
        "local_privileged_module": F.lit("false"),
        "local_module_relative_path": F.lit(""),
        "local_overrides_packages": F.col("p_name"),
    }
    text = bd.render_template(APP_MK_TEMPLATE, values)
    return t.part.select("p_partkey", F.md5(text).alias("descriptor_md5"), (F.col("p_size") > 25).alias("is_large"))


@query("template_formats")
def template_formats(t: Tables) -> DataFrame:
    """The other descriptor formats, filled for every part."""
    path = app_path()
    values = {
        "local_module": F.col("p_name"),
        "local_src_files": F.concat(F.col("p_name"), F.lit(".apk")),
        "local_certificate": bd.signing_key(F.lit(None), F.col("p_name")),
        "local_privileged_module": path.contains("/priv-app").cast("string"),
        "local_filename": F.col("p_name"),
        "local_optional_uses_libraries": F.lit(""),
        "local_enforce_uses_libraries": F.lit("false"),
        "local_overrides": cl.app_override("p_name"),
        "product_specific": path.contains("/product").cast("string"),
        "proprietary": (path.contains("/vendor") | path.contains("/odm")).cast("string"),
        "local_module_path": F.lit("/x/"),
        "local_prebuilt_module_file": F.concat(F.lit("$(LOCAL_PATH)/"), F.col("p_name")),
    }
    return t.part.select(
        "p_partkey",
        bd.render_template(APP_BP_TEMPLATE, values).alias("app_bp"),
        bd.render_template(LIBRARY_MK_TEMPLATE, values).alias("library_mk"),
    )


# --- paths ---------------------------------------------------------------------------------


def url_path() -> Column:
    return F.regexp_extract("url", "://([^?#]*)", 1)


@query(
    "path_parts",
    r"""
    WITH p AS (SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS u FROM pages)
    SELECT page_id, '/' || rtrim(replace(u, '.example', ''), '/') AS normal,
           CASE WHEN regexp_extract('/' || u, '([^/]*)/[^/]*$', 1) = regexp_extract(u, '^([^/]*)', 1) THEN '/'
                ELSE regexp_extract('/' || u, '([^/]*)/[^/]*$', 1) END AS parent,
           substr(u, length(regexp_extract(u, '^([^/]*)', 1)) + 1) AS relative FROM p
    """,
)
def path_parts(t: Tables) -> DataFrame:
    path = F.concat(F.lit("/"), url_path())
    root = F.concat(F.lit("/"), F.regexp_extract(url_path(), "^([^/]*)", 1))
    messy = F.concat(F.lit(" //./x/.."), F.replace(path, F.lit(".example"), F.lit("")), F.lit(" "))
    return t.pages.select(
        "page_id",
        pt.normalize_path(messy).alias("normal"),
        pt.parent_name(path, root).alias("parent"),
        pt.relative_path(path, root).alias("relative"),
    )


@query(
    "segment_filter",
    "SELECT page_id, '/' || regexp_extract(url, '://([^?#]*)', 1) AS kept FROM pages",
)
def segment_filter(t: Tables) -> DataFrame:
    path = F.concat(F.lit("/a.zip_extract/"), url_path())
    return t.pages.select("page_id", pt.drop_marked_segments(path).alias("kept"))


@query(
    "subfolders",
    r"""
    WITH p AS (SELECT page_id, string_split('/x/' || regexp_extract(url, '://([^?#]*)', 1) || '/y/z.so', '/') AS s FROM pages)
    SELECT page_id, array_to_string(CASE WHEN list_position(s, 'en') > 0 THEN s[list_position(s, 'en') + 1 : len(s) - 1] ELSE [] END, '/') AS folders FROM p
    """,
)
def subfolders(t: Tables) -> DataFrame:
    path = F.concat(F.lit("/x/"), url_path(), F.lit("/y/z.so"))
    return t.pages.select("page_id", F.array_join(pt.subfolders_after(path, F.lit("en")), "/").alias("folders"))


@query(
    "replace_last",
    r"SELECT page_id, regexp_replace(url, '^(.*)[.]', '\1$') AS replaced FROM pages",
)
def replace_last(t: Tables) -> DataFrame:
    return t.pages.select("page_id", pt.replace_last("url", ".", "$").alias("replaced"))
