"""Report sources: JSON and XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import as_col
from ..operators.rules import RULE_SCHEMA
from ..rule_catalog import rule_rows


def read_report_files(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """Report files, one document each, as path and JSON text; broken documents are marked."""
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return texts.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("value").alias("results"),
        F.when(F.try_parse_json("value").isNotNull(), F.lit("completed")).otherwise(F.lit("failed")).alias("scan_status"),
    )


def read_report_lines(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Reports stored one JSON document per line, with a given schema."""
    return spark.read.schema(schema).json(root)


def read_rules(spark: SparkSession, folder: str) -> DataFrame:
    """A rule folder with one JSON document per file."""
    return spark.read.schema(RULE_SCHEMA).option("multiLine", "true").json(folder)


def builtin_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rule_rows(), RULE_SCHEMA)


def read_xml(spark: SparkSession, root: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(root)


MANIFEST_COMPONENT = (
    "struct<`_android:name`:string,`_android:exported`:string,"
    "`intent-filter`:array<struct<action:array<struct<`_android:name`:string>>>>>"
)
MANIFEST_SCHEMA = (
    "struct<_package:string,`_android:sharedUserId`:string,application:struct<`_android:debuggable`:string,"
    f"activity:array<{MANIFEST_COMPONENT}>,receiver:array<{MANIFEST_COMPONENT}>>>"
)


def manifest_components(apps: DataFrame, id_col: str, xml: Column | str) -> DataFrame:
    """Manifest XML as component rows ``(app_id, kind, name, exported, has_filter, debuggable)``."""
    parsed = apps.select(
        F.col(id_col).alias("app_id"),
        F.from_xml(as_col(xml), MANIFEST_SCHEMA, {"mode": "PERMISSIVE"}).alias("_m"),
    )
    empty = F.array().cast(f"array<{MANIFEST_COMPONENT}>")

    def rows(kind: str) -> Column:
        return F.transform(
            F.coalesce(F.col(f"_m.application.{kind}"), empty),
            lambda c: F.struct(
                F.lit(kind).alias("kind"),
                c["_android:name"].alias("name"),
                F.coalesce(c["_android:exported"] == "true", F.lit(False)).alias("exported"),
                (F.coalesce(F.size(c["intent-filter"]), F.lit(0)) > 0).alias("has_filter"),
                F.lit(False).alias("debuggable"),
            ),
        )

    application = F.array(
        F.struct(
            F.lit("application").alias("kind"),
            F.col("_m._package").alias("name"),
            F.lit(False).alias("exported"),
            F.lit(False).alias("has_filter"),
            F.coalesce(F.col("_m.application._android:debuggable") == "true", F.lit(False)).alias("debuggable"),
        )
    )
    components = F.explode(F.concat(application, rows("activity"), rows("receiver")))
    return parsed.select("app_id", components.alias("_c")).select("app_id", "_c.*")


def taint_results(xml: Column | str) -> Column:
    """Taint report text; an empty report is a result of its own."""
    text = as_col(xml)
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit('{"NoMatch":"No taints matched!"}')).otherwise(text)
