"""Files and sinks: rows of the given tables are written to the work folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.build import meta_group, module_name
from ..operators import properties as pr
from ..operators import similarity as sim
from ..operators.rules import RULE_SCHEMA
from ..session import new_work_dir
from ..sources import files as fs
from ..sources import reports as rs
from ..sources import sinks as sk
from .registry import Tables, query


def document_tree(t: Tables) -> str:
    """Document texts as files below a folder per source and language, one of them hidden."""
    path = new_work_dir(t.spark, "tree")
    name = F.concat_ws("/", "source", F.concat(F.lit("."), "lang"), F.concat(F.lit("d"), "doc_id", F.lit(".txt")))
    fs.write_files(t.spread("documents", "doc_id").select(name.alias("name"), F.encode("text", "utf-8").alias("content")), path)
    return path


@query(
    "file_inventory",
    """
    SELECT source || '/.' || lang AS folder, true AS is_directory, NULL::BIGINT AS bytes FROM documents GROUP BY 1
    UNION ALL SELECT source, true, NULL FROM documents GROUP BY 1
    UNION ALL SELECT source || '/.' || lang, false, sum(strlen(text))::BIGINT FROM documents GROUP BY 1
    """,
)
def file_inventory(t: Tables) -> DataFrame:
    """Directories of the tree, and the bytes of the files in each."""
    rows = fs.file_inventory(t.spark, document_tree(t), F.lit("system")).withColumn("relative_path", F.expr("substring(relative_path, 2)"))
    directories = rows.where("is_directory").select(F.col("relative_path").alias("folder"), "is_directory", F.col("size").alias("bytes"))
    files = rows.where(~F.col("is_directory"))
    folder = F.regexp_replace("relative_path", "/[^/]*$", "")
    return directories.unionByName(
        files.groupBy(folder.alias("folder"), "is_directory").agg(F.sum("size").alias("bytes"))
    )


@query(
    "file_tree_rows",
    """
    SELECT 'd' || doc_id || '.txt' AS name, '.' || lang AS parent_dir, '/' || source || '/.' || lang || '/d' || doc_id || '.txt' AS relative_path,
      false AS is_directory, strlen(text)::BIGINT AS size, md5(text) AS md5, 'system' AS partition_name FROM documents
    UNION ALL SELECT DISTINCT '.' || lang, source, '/' || source || '/.' || lang, true, NULL, NULL, 'system' FROM documents
    UNION ALL SELECT DISTINCT source, '/', '/' || source, true, NULL, NULL, 'system' FROM documents
    """,
)
def file_tree_rows(t: Tables) -> DataFrame:
    rows = fs.file_inventory(t.spark, document_tree(t), F.lit("system"))
    return rows.select("name", "parent_dir", "relative_path", "is_directory", "size", "md5", "partition_name")


@query(
    "folder_scan",
    """
    SELECT 'd' || doc_id || (CASE WHEN lang = 'de' THEN '.zip' ELSE '.tar.gz' END) AS name, strlen(text)::BIGINT AS size, md5(text) AS md5
    FROM documents WHERE lang <> 'fr'
    """,
)
def folder_scan(t: Tables) -> DataFrame:
    """Archives of an import folder, beside files that are none."""
    path = new_work_dir(t.spark, "imports")
    ending = F.when(F.col("lang") == "de", ".zip").when(F.col("lang") == "fr", ".txt").otherwise(".tar.gz")
    fs.write_files(t.spread("documents", "doc_id").select(F.concat(F.lit("d"), "doc_id", ending).alias("name"), F.encode("text", "utf-8").alias("content")), path)
    return fs.import_candidates(t.spark, path).select("name", "size", "md5")


@query(
    "loose_apps",
    """
    SELECT (CASE WHEN lang = 'de' THEN '.d' ELSE 'd' END) || doc_id || (CASE WHEN lang = 'en' THEN '.apk' ELSE '.APK' END) AS name,
      strlen(text)::BIGINT AS size, md5(text) AS md5 FROM documents WHERE lang <> 'fr'
    """,
)
def loose_apps(t: Tables) -> DataFrame:
    """App files by suffix, some with hidden names, beside files that are none."""
    path = new_work_dir(t.spark, "apps")
    ending = F.when(F.col("lang") == "en", ".apk").when(F.col("lang") == "fr", ".txt").otherwise(".APK")
    name = F.concat(F.when(F.col("lang") == "de", ".d").otherwise("d"), "doc_id", ending)
    fs.write_files(t.spread("documents", "doc_id").select(name.alias("name"), F.encode("text", "utf-8").alias("content")), path)
    return fs.loose_apps(t.spark, path)


@query(
    "line_source",
    r"""
    WITH l AS (SELECT page_id, unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) AS line FROM pages WHERE url LIKE '%?%')
    SELECT 'p' || page_id || '_' || string_split(line, '=')[1] AS key, string_split(line, '=')[2] AS value FROM l
    """,
)
def line_source(t: Tables) -> DataFrame:
    path = new_work_dir(t.spark, "lines")
    query_part = F.regexp_extract("url", r"\?([^#]*)", 1)
    lines = t.pages.where(query_part != "").select("page_id", F.explode(F.split(query_part, "&")).alias("line"))
    lines.select(F.concat(F.lit("p"), F.col("page_id"), F.lit("."), F.col("line")).alias("value")).write.text(path)
    rows = fs.line_rows(t.spark, path, "*.txt")
    return pr.last_value_per_key(pr.property_rows(rows), "file_path", "line_no").select("key", "value")


@query(
    "json_source",
    "SELECT event_id, user_id, event_type, regexp_extract(props, ': ([0-9]+)', 1)::INT AS k FROM events",
)
def json_source(t: Tables) -> DataFrame:
    path = new_work_dir(t.spark, "reports")
    t.events.select("event_id", "user_id", "event_type", F.from_json("props", "struct<k:int>").alias("props")).write.json(path)
    stored = rs.read_report_lines(t.spark, path, "event_id long, user_id long, event_type string, props struct<k:int>")
    return stored.select("event_id", "user_id", "event_type", "props.k")


@query(
    "report_files",
    "SELECT item_id, length(text)::INT AS n_chars, 'completed' AS scan_status FROM benchmark",
)
def report_files(t: Tables) -> DataFrame:
    """Report documents, one per file."""
    path = new_work_dir(t.spark, "documents")
    document = F.to_json(F.struct("item_id", "text"))
    t.benchmark.select(document.alias("value"), "item_id").write.option("lineSep", "\n").partitionBy("item_id").text(path)
    stored = rs.read_report_files(t.spark, path, "*.txt")
    parsed = stored.select("scan_status", F.from_json("results", "struct<item_id:long,text:string>").alias("r"))
    return parsed.select("r.item_id", F.length("r.text").alias("n_chars"), "scan_status")


@query(
    "rule_source",
    "SELECT p_type AS crime, count(*)::DOUBLE AS score, 2 AS calls FROM part GROUP BY 1",
)
def rule_source(t: Tables) -> DataFrame:
    """A rule folder: one rule per part type, written and loaded as JSON."""
    path = new_work_dir(t.spark, "rules")
    call = F.struct(F.lit("P").alias("class"), F.col("p_type").alias("method"), F.lit("()V").alias("descriptor"))
    rules = t.part.groupBy("p_type").agg(F.count("*").cast("double").alias("score")).select(
        F.col("p_type").alias("crime"), F.array().cast("array<string>").alias("permission"), F.array(call, call).alias("api"),
        "score", F.array("p_type").alias("label"),
    )
    rules.write.option("ignoreNullFields", "false").json(path)
    return rs.read_report_lines(t.spark, path, RULE_SCHEMA).select("crime", "score", F.size("api").alias("calls"))


@query(
    "xml_source",
    "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT c_custkey + 1000, c_name, c_nationkey FROM customer",
)
def xml_source(t: Tables) -> DataFrame:
    path = new_work_dir(t.spark, "xml")
    rows = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).unionByName(
        t.customer.select((F.col("c_custkey") + 1000).alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("region"))
    )
    rows.write.format("xml").option("rowTag", "component").option("rootTag", "manifest").save(path)
    return rs.read_xml(t.spark, path, "component", "id long, name string, region int")


@query("json_sink", "SELECT o_orderkey AS id, o_orderpriority AS key FROM orders")
def json_sink(t: Tables) -> DataFrame:
    path = new_work_dir(t.spark, "references")
    sk.write_references(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("key")), path, "key")
    return t.spark.read.schema("id long, key string").json(path)


@query(
    "partitioned_export",
    """
    SELECT doc_id, source AS firmware_id, lang AS partition_name, source || '/' || lang || '/app/' AS folder, md5(text) AS md5
    FROM documents WHERE lang IN ('en', 'fr')
    """,
)
def partitioned_export(t: Tables) -> DataFrame:
    path = new_work_dir(t.spark, "export")
    name = F.concat(F.col("doc_id"), F.lit(".txt"))
    relative = F.concat(F.lit("/a_extract/app/"), name)
    files = t.documents.where(F.col("lang").isin("en", "fr")).select(
        "doc_id", F.col("source").alias("firmware_id"), F.col("lang").alias("partition_name"),
        sk.export_folder(F.col("source"), F.col("lang"), relative, name).alias("folder"), F.md5("text").alias("md5"),
    )
    sk.export_files(files, path)
    return t.spark.read.parquet(path)


@query(
    "log_append",
    """
    SELECT event_id, CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level, event_type AS message, 'scan' AS tags,
      strftime(ts, '%Y-%m-%d') AS day FROM events
    """,
)
def log_append(t: Tables) -> DataFrame:
    path = new_work_dir(t.spark, "log")
    records = t.events.select(
        "event_id", "ts", F.when(F.col("event_type") == "error", "ERROR").otherwise(F.col("event_type")).alias("level"),
        F.col("event_type").alias("message"),
    )
    sk.append_log(records.where("message <> 'view'"), path, ["scan"])
    sk.append_log(records.where("message = 'view'"), path, ["scan"])
    stored = t.spark.read.parquet(path)
    return stored.select("event_id", "level", "message", F.array_join("tags", ",").alias("tags"), F.col("day").cast("string").alias("day"))


GROUPS = ["vendor", "product", "SYSTEM_EXT", "system", "oem"]


@query(
    "group_text_sink",
    f"""
    SELECT '    ' || translate(p_name, '.@- ', '____') || '_prebuilt' || ' \\' AS line,
       ['vendor', 'product', 'system_ext', 'system', 'vendor'][(p_partkey % {len(GROUPS)} + 1)::INT] AS meta_group FROM part
    """,
)
def group_text_sink(t: Tables) -> DataFrame:
    path = new_work_dir(t.spark, "modules")
    partition = F.element_at(F.array(*[F.lit(g) for g in GROUPS]), (F.col("p_partkey") % len(GROUPS) + 1).cast("int"))
    modules = t.part.select(module_name("p_name").alias("module"), partition.alias("partition_name"))
    sk.write_module_lists(modules, path, "module", "partition_name")
    return t.spark.read.text(path).select(F.col("value").alias("line"), "meta_group")


@query(
    "graph_sink",
    """
    SELECT 'nodes' AS part, count(DISTINCT l_suppkey) + count(DISTINCT l_partkey) AS n FROM lineitem
    UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) e
    UNION ALL SELECT 'membership', count(DISTINCT l_partkey) FROM lineitem
    """,
)
def graph_sink(t: Tables) -> DataFrame:
    """A graph of suppliers (negative nodes) and parts, written as three tables and counted again."""
    path = new_work_dir(t.spark, "graph")
    edges = t.lineitem.select((-F.col("l_suppkey") - 1).alias("src"), F.col("l_partkey").alias("dst")).distinct()
    nodes = sim.adjacency(edges).select(F.col("src").alias("node")).distinct()
    membership = edges.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("group"))
    sk.write_graph(nodes, edges, membership, path)
    parts = [
        t.spark.read.parquet(f"{path}/{part}").agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
        for part in ("nodes", "edges", "membership")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("meta_group_counts", "SELECT CASE WHEN lang = 'en' THEN 'product' ELSE 'system' END AS meta_group, count(*) AS n FROM documents GROUP BY 1")
def meta_group_counts(t: Tables) -> DataFrame:
    partition = F.when(F.col("lang") == "en", "Product").otherwise(F.col("lang"))
    return t.documents.groupBy(meta_group(partition).alias("meta_group")).agg(F.count("*").alias("n"))
