import datetime
import os
import signal
import time

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import build
from corpuslens.functions.properties import parse_properties
from corpuslens.operators import inventory, isolated, numbering, properties, quality, rules, scan, scanners, snapshots, stats
from corpuslens.rule_catalog import CHECKERS, RULES, rule_rows


@pytest.fixture(scope="module")
def firmware(spark):
    return spark.createDataFrame(
        [(1, "Unknown", ["a"]), (2, "LG", ["b"]), (3, "Unknown", [])], "id long, os_vendor string, tags array<string>"
    )


def test_filters_are_checked(firmware):
    with pytest.raises(ValueError) as error:
        scan.scan(firmware, filters={"nope": 1, "id": "x"})
    assert "nope" in str(error.value) and "id" in str(error.value)
    assert scan.filter_arguments(firmware.schema)["tags"] == "array<string>"


def test_scan_with_ids(spark, firmware):
    assert scan.scan(firmware, ids=[1, 2], filters={"os_vendor": "LG", "tags": None}).count() == 1
    assert scan.scan(firmware, ids=[]).count() == 3
    many = list(range(2, 5000))
    assert {r["id"] for r in scan.scan(firmware, ids=many).collect()} == {2, 3}
    assert scan.scan(firmware, filters={"tags": ["a"]}).count() == 1
    assert scan.scan(firmware, filters={"tags": ["a", "b"]}, any_of_list=True).count() == 2


def test_scan_reaches_the_file(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select("id", (F.col("id") * 2).alias("a"), F.lit("x").alias("b")).write.parquet(path)
    plan = scan.scan(spark.read.parquet(path), ids=[3, 4], filters={"a": 6}, columns=["id"])._jdf.queryExecution().toString()
    assert "In(id, [3,4])" in plan and "EqualTo(a,6)" in plan and "ReadSchema: struct<id:bigint,a:bigint>" in plan


def test_numbering_with_few_and_many_rows(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5003).alias("id"))
    found = [r["row_no"] for r in numbering.numbered(df, "id").orderBy("id").collect()]
    assert found == list(range(5000))
    chunks = numbering.chunked(df, "id", 1000).groupBy("chunk_no").count().collect()
    assert sorted((r["chunk_no"], r["count"]) for r in chunks) == [(i, 1000) for i in range(5)]


def test_places_in_a_hot_group(spark):
    df = spark.range(900).select(F.when(F.col("id") < 600, 1).otherwise(F.col("id")).alias("g"), "id")
    hot = numbering.placed_in_group(df, "g", "id").where("g = 1").orderBy("id").collect()
    assert [r["place"] for r in hot] == list(range(1, 601))


def test_first_and_last_file_win(spark):
    files = spark.createDataFrame(
        [
            ("f", 1, {"x": "1"}), ("f", 2, {"ro_product_brand": "nokia", "ro_build_version_release": "9"}),
            ("f", 3, {"ro_product_brand": "htc", "ro_build_version_release": "10.1"}), ("g", 1, {"y": "z"}),
        ],
        "firmware_id string, ordinal int, properties map<string,string>",
    )
    assert {tuple(r) for r in properties.detect_vendors(files, "firmware_id", "ordinal").collect()} == {("f", "Nokia"), ("g", "Unknown")}
    assert {tuple(r) for r in properties.detect_versions(files, "firmware_id", "ordinal").collect()} == {("f", 10), ("g", 0)}


def test_vendor_update_counts_changes(spark, firmware):
    detected = spark.createDataFrame([(1, "Sony"), (2, "Sony"), (3, "Unknown")], "id long, os_vendor string")
    rows = properties.update_vendors(firmware, detected, "id", F.col("os_vendor") == "Unknown").collect()
    assert {(r["id"], r["os_vendor"], r["updated"]) for r in rows} == {(1, "Sony", True), (2, "LG", False), (3, "Unknown", False)}


def test_optimised_siblings(spark):
    apps = spark.createDataFrame([(1, "f", "/app/X/X.apk"), (2, "f", "/app/Y/Y.apk"), (3, "f", "/Z.apk")], "app_id int, firmware_id string, path string")
    files = spark.createDataFrame(
        [
            (10, "f", "/app/X/oat/arm/X.odex"), (11, "f", "/app/X/X.apk.prof"), (12, "f", "/app/Y/X.vdex"), (13, "g", "/app/X/X.art"),
            (14, "f", "/deep/Z.art"),
        ],
        "file_id int, firmware_id string, path string",
    )
    found = {tuple(r) for r in inventory.optimised_siblings(apps, files).collect()}
    assert found == {(1, 10, ".odex"), (1, 11, ".apk.prof"), (3, 14, ".art")}


def test_duplicates_are_stable_under_deduplication(spark):
    files = spark.createDataFrame([(i, "f%d" % (i % 3), "h" if i < 600 else str(i)) for i in range(900)], "id int, fw string, md5 string")
    once = inventory.duplicate_content(files, "md5", "fw", "id").collect()
    assert [(r["md5"], r["copies"], r["owners"], r["first_id"]) for r in once] == [("h", 600, 3, 0)]
    again = inventory.duplicate_content(files.dropDuplicates(["md5"]), "md5", "fw", "id")
    assert again.isEmpty()


def test_snapshots(spark):
    current = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, w string")
    changes = spark.createDataFrame([(2, None, "z"), (3, "c", None)], "id int, v string, w string")
    assert {tuple(r) for r in snapshots.upsert(current, changes, ["id"]).collect()} == {(1, "a", "x"), (2, "b", "z"), (3, "c", None)}
    ids = spark.createDataFrame([(1,)], "id int")
    child = spark.createDataFrame([(7, 1), (8, None), (9, 2)], "cid int, ref int")
    kept = snapshots.delete_cascade({"p": current, "c": child}, "p", ids, "id", {"p": {"c": "ref"}})
    assert {r["cid"] for r in kept["c"].collect()} == {8, 9} and kept["p"].count() == 1
    routed = snapshots.route(current, {"bad": F.col("v") == "a"})
    good, bad = snapshots.split_routed(routed)
    assert good.count() == 1 and bad.first()["reason"] == "bad"


@pytest.mark.parametrize(
    "name, allowed",
    [("firmware.zip", True), ("system.tar.gz", True), ("boot.lz4", True), ("firmware.txt", False), ("system.exe", False), ("boot.img", False)],
)
def test_upload_extensions(value_of, name, allowed):
    errors = value_of(quality.errors_of(quality.upload_rules(F.lit(name), F.lit("firmware"), F.lit(21), F.lit("0"))))
    assert (errors == []) == allowed


def test_all_errors_are_reported(value_of):
    errors = value_of(quality.errors_of(quality.upload_rules(F.lit("a.apk"), F.lit("photo"), F.lit(0), F.lit("x"))))
    assert errors == ["type", "storage index", "empty", "app type"]
    assert quality.check_regex("a+b") == "a+b"
    for bad in ("(", "x" * 501, "(?=a)+"):
        with pytest.raises(ValueError):
            quality.check_regex(bad)


# --- rules ---------------------------------------------------------------------------------


def call_rows(name, caller, args=(), methods=(), reverse=False, extra=()):
    _, first, second = RULES[name]
    ordered = [second, first] if reverse else [first, second]
    rows = [("app", caller, i, *c, list(args), list(methods)) for i, c in enumerate(ordered)]
    return rows + [("app", caller, 10 + i, *c, list(a), []) for i, (c, a) in enumerate(extra)]


CALL_SCHEMA = (
    "app_id string, caller string, seq int, callee_class string, callee_method string, descriptor string, "
    "args array<string>, arg_methods array<string>"
)
MATCHES = ("Ljava/lang/String;", "matches", "(Ljava/lang/String;)Z")
SET_JS = RULES["configureJsExecution"][2]
CHECK_SIGNATURES = ("Landroid/content/pm/PackageManager;", "checkSignatures", "(Ljava/lang/String; Ljava/lang/String;)I")
EXPOSE = ("Landroid/webkit/WebView;", "addJavascriptInterface", "(Ljava/lang/Object;Ljava/lang/String;)V")
DIGEST = ("Ljava/security/MessageDigest;", "getInstance", "(Ljava/lang/String;)Ljava/security/MessageDigest;")
START = ("Lx/Y;", "startActivity", "(Landroid/content/Intent;)V")

CHECKER_CASES = [
    ("CWE20", call_rows("openUrlThatUserInput", "m", methods=["getText"]), True),
    ("CWE20", call_rows("openUrlThatUserInput", "m", methods=["matches"]), False),
    ("CWE20", call_rows("openUrlThatUserInput", "m", reverse=True), False),
    ("CWE22", call_rows("accessFileInExternalDir", "m", args=["a", "b", "path"]), True),
    ("CWE22", call_rows("accessFileInExternalDir", "m", args=["a", "b", '"fixed"']), False),
    ("CWE22", call_rows("accessFileInExternalDir", "m", args=["a", "b"]), False),
    ("CWE22", call_rows("accessFileInExternalDir", "m", args=["a", "b", "path"], extra=[(MATCHES, [])]), False),
    ("CWE23", call_rows("accessFileInExternalDir", "m", args=["a", "b", "path"], extra=[(MATCHES, [])]), True),
    ("CWE78", call_rows("externalStringCommand", "m", args=["ls"], methods=["matches"]), False),
    ("CWE78", call_rows("externalStringCommand", "m", args=["ls | x"], methods=["matches"]), True),
    ("CWE79", call_rows("loadUrlFromIntent2", "m", extra=[(SET_JS, ["s", "1"])]), True),
    ("CWE79", call_rows("loadUrlFromIntent2", "m", extra=[(SET_JS, ["s", "0"])]), False),
    ("CWE88", call_rows("externalStringCommand", "m", args=["ls"], methods=["indexOf"]), False),
    ("CWE89", call_rows("executeSQLCommand", "m", methods=["getText"]), True),
    ("CWE89", call_rows("executeSQLCommand", "m", methods=["other"]), False),
    ("CWE94", call_rows("loadExternalCode", "m"), True),
    ("CWE94", call_rows("loadExternalCode", "m", extra=[(CHECK_SIGNATURES, [])]), False),
    ("CWE117", call_rows("writeContentToLog", "m", args=["tag", "text"]), True),
    ("CWE117", call_rows("writeContentToLog", "m", args=["tag", "escape(text)"]), False),
    ("CWE319", call_rows("setRetrofitBaseUrl", "m", args=["http://a.b/c"]), True),
    ("CWE319", call_rows("setRetrofitBaseUrl", "m", args=["https://a.b/c"]), False),
    ("CWE327", call_rows("useOfCryptographicAlgo", "m", args=["DES/CBC"]), True),
    ("CWE327", call_rows("useOfCryptographicAlgo", "m", args=["AES"]), False),
    ("CWE328", [("app", "m", 1, *DIGEST, ["MD-5"], [])], True),
    ("CWE328", [("app", "m", 1, *DIGEST, ["SHA-256"], [])], False),
    ("CWE502", call_rows("deserializeData", "m", methods=["read"]), True),
    ("CWE502", call_rows("deserializeData", "m", methods=["getFilesDir"]), False),
    ("CWE532", [("app", "m", 1, "Landroid/util/Log;", "d", "(Ljava/lang/String;Ljava/lang/String;)I", ["t", "password=x"], [])], True),
    ("CWE601", [("app", "m", 1, *START, ["getIntent()"], [])], True),
    ("CWE601", [("app", "m", 1, *START, ["Uri.parse(getIntent())"], [])], False),
    ("CWE749", call_rows("configureJsExecution", "m", args=["s", "true"], extra=[(EXPOSE, [])]), True),
    ("CWE749", call_rows("configureJsExecution", "m", args=["s", "true"]), False),
    ("CWE780", call_rows("useOfCryptographicAlgo", "m", args=["RSA/ECB/PKCS1Padding"]), True),
    ("CWE780", call_rows("useOfCryptographicAlgo", "m", args=["RSA/ECB/OAEPPadding"]), False),
    ("CWE921", call_rows("checkFileExistence", "m", args=["/sdcard/x"]), True),
    ("CWE940", call_rows("loadUrlFromIntent", "m", methods=["getStringExtra"]), True),
    ("CWE940", call_rows("loadUrlFromIntent", "m", methods=["getStringExtra", "verify"]), False),
    ("CWE73", call_rows("accessFileInExternalDir", "m", args=["a", "b", "path"]), False),
]


def test_builtin_checkers(spark):
    rows = []
    for i, (_, calls, _) in enumerate(CHECKER_CASES):
        rows.extend((f"app{i}", *row[1:]) for row in calls)
    found = {(r["app_id"], r["checker"]) for r in rules.run_checkers(spark.createDataFrame(rows, CALL_SCHEMA), CHECKERS).collect()}
    for i, (name, _, expected) in enumerate(CHECKER_CASES):
        assert ((f"app{i}", name) in found) == expected, CHECKER_CASES[i]


def test_behaviours_and_permissions(spark):
    catalogue = spark.createDataFrame(rule_rows(), rules.RULE_SCHEMA).withColumn("permission", F.array(F.lit("p")))
    calls = spark.createDataFrame(
        call_rows("useMethodOfPRNG", "a") + call_rows("useMethodOfPRNG", "b", reverse=True) + call_rows("deserializeData", "c")[:1], CALL_SCHEMA
    )
    found = {(r["caller"], r["in_order"]) for r in rules.behaviours(calls, catalogue).collect()}
    assert found == {("a", True), ("b", False)}
    held = spark.createDataFrame([("app", ["q"])], "app_id string, permissions array<string>")
    assert rules.behaviours(calls, catalogue, held).isEmpty()


def test_ancestors(spark):
    tree = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", None)], "name string, extends string")
    assert {(r["name"], r["ancestor"]) for r in rules.ancestors(tree).collect()} == {("A", "B"), ("A", "C"), ("B", "C")}
    chain = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(10)] + [("x", "y"), ("y", "x")], "name string, extends string")
    found = {(r["name"], r["ancestor"]): r["depth"] for r in rules.ancestors(chain).collect()}
    assert found[("c0", "c10")] == 10 and len([k for k in found if k[0][0] == "c"]) == 55
    assert {k for k in found if k[0] in "xy"} == {("x", "y"), ("y", "x"), ("x", "x"), ("y", "y")}



# --- scanners and statistics ---------------------------------------------------------------


def test_scanner_isolates_failures(spark):
    items = spark.createDataFrame([(1, bytearray(b"a b\nc")), (2, bytearray(b"\xff\xfe")), (3, bytearray(b""))], "id int, content binary")
    reports = {r["id"]: r for r in scanners.run_scanner(items, "TEXT", "id", "content").collect()}
    assert (reports[1]["scan_status"], reports[1]["n_words"]) == ("completed", 3)
    assert reports[2]["scan_status"] == "failed" and "utf-8" in reports[2]["error"] and reports[2]["n_words"] is None
    assert reports[3]["scan_status"] == "completed"
    with pytest.raises(ValueError):
        scanners.find_scanner("NOPE")
    assert scanners.empty_result(scanners.FlagScanner.result_schema) == {"main_marker": "", "markers": []}


def test_batches_and_single_items_agree(spark):
    contents = [b"a b\nc", b"\xff\xfe", b"", None, b"   ", "é\u2003x \n\n".encode(), b"\n", b"long enough text here"]
    items = spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "id int, content binary").coalesce(1)

    class Single:
        name, version, result_schema, scan = "TEXT", "1", scanners.TextScanner.result_schema, scanners.TextScanner.scan

    for arguments in ({}, {"min_bytes": 4}):
        whole = scanners.run_scanner(items, "TEXT", "id", "content", arguments).drop("error").collect()
        single = scanners.run_scanner(items, Single(), "id", "content", arguments).drop("error").collect()
        assert sorted(map(str, whole)) == sorted(map(str, single))


def test_a_scan_that_hangs_or_dies_costs_one_item(spark):
    class Moody:
        """Does what the content says: sleeps, dies, raises, or answers."""

        name, version, result_schema = "MOODY", "1", scanners.TextScanner.result_schema

        def scan(self, content, factor="1"):
            what, _, value = content.decode().partition(" ")
            if what == "sleep":
                time.sleep(float(value))
            elif what == "die":
                os.kill(os.getpid(), signal.SIGKILL)
            elif what == "exit":
                os._exit(3)
            elif what == "raise":
                raise ValueError(value)
            return {"n_lines": os.getpid(), "n_words": len(value) * int(factor)}

    items = [(1, "ok aa", None, None), (2, "sleep 60", 0.3, None), (3, "ok b", None, {"factor": "5"}), (4, "die", None, None), (5, "ok", None, None),
             (6, "exit", None, None), (7, "raise bad", None, None), (8, "ok cc", None, None), (9, None, None, None), (10, "ok " + "x" * 100, None, None),
             (11, "sleep 0.4", 5.0, None)]
    table = spark.createDataFrame([(i, c, s, a) for i, c, s, a in items], "id int, content string, most double, own map<string,string>").coalesce(1)
    began = time.time()
    found = isolated.run_isolated(table, Moody(), "id", "content", {"factor": 2}, seconds=20, seconds_col="most", max_bytes=50, arguments_col="own").collect()
    assert time.time() - began < 30
    rows = {r["id"]: r for r in found}
    assert {i for i, r in rows.items() if r["scan_status"] == "completed"} == {1, 3, 5, 8, 11}
    assert [rows[i]["n_words"] for i in (1, 3, 5, 8)] == [4, 5, 0, 4]
    errors = {i: r["error"] for i, r in rows.items() if r["error"]}
    assert errors == {
        2: "took longer than 0.3 seconds", 4: "the scan ended its process with -9", 6: "the scan ended its process with 3",
        7: "bad", 9: "no content", 10: "larger than 50 bytes",
    }
    assert rows[2]["scan_seconds"] < 3 and rows[11]["scan_seconds"] > 0.3
    # A new child only where the one before was lost.
    pids = [rows[i]["n_lines"] for i in (1, 3, 5, 8)]
    assert len(set(pids)) == 4 and rows[8]["n_lines"] == rows[11]["n_lines"]


def test_statistics_shapes(spark):
    df = spark.createDataFrame([(1, "a", ["x", "x"]), (2, "a", []), (3, None, None)], "id int, v string, tags array<string>")
    assert {tuple(r) for r in stats.atomic_counts(df, ["v"]).collect()} == {("v", "a", 2)}
    assert {tuple(r) for r in stats.list_counts(df, ["tags"]).collect()} == {("tags", "x", 2)}
    assert {tuple(r) for r in stats.presence_counts(df, ["tags"]).collect()} == {("tags", "true", 1), ("tags", "false", 2)}
    assert stats.list_references(df, ["tags"], "id").count() == 1


def test_library_path_and_app_path(value_of):
    path = value_of(build.app_install_path(F.lit("/s/system/priv-app/X/X.apk"), F.lit("system"), F.lit("X.apk")))
    assert path == "$(TARGET_OUT)/priv-app/"
    assert value_of(build.library_install_path(F.lit("/s/system/lib/a.so"), F.lit("system"), F.lit("a.so"), "bp")) == ""
    assert value_of(F.lit(datetime.date(2024, 1, 1))) == datetime.date(2024, 1, 1)


def test_cascade_over_levels_and_several_ways(spark):
    tables = {
        "f": spark.createDataFrame([(1,), (2,)], "id long"),
        "a": spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id long, f long"),
        "b": spark.createDataFrame([(20, 1, 11), (21, 2, 10), (22, 2, 11)], "id long, f long, a long"),
        "r": spark.createDataFrame([(30, 20), (31, 21), (32, 22), (33, None)], "id long, b long"),
    }
    kept = snapshots.delete_cascade(
        tables, "f", spark.createDataFrame([(1,)], "id long"), "id", {"f": {"a": "f", "b": "f"}, "a": {"b": "a"}, "b": {"r": "b"}}
    )
    assert {n: sorted(r["id"] for r in df.collect()) for n, df in kept.items()} == {"f": [2], "a": [11, 12], "b": [22], "r": [32, 33]}


def test_id_lists_short_and_long_compare_alike(spark, monkeypatch):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    for limit in (1000, 0):
        monkeypatch.setattr(scan, "IN_LIST_ROWS", limit)
        assert sorted(r["id"] for r in scan.with_ids(df, ["1", 3, "no", None], "id").collect()) == [1, 3]


def test_property_lines_lose_white_space_at_their_end(spark):
    lines = ["ro.a=1\r", "ro.b=x\t\r", "ro.a=2 \u00a0", " =x", "a=b=c", "none", ""]
    found = spark.createDataFrame([(lines,)], "lines array<string>").select(parse_properties("lines").alias("p")).first()["p"]
    assert found == {"ro_a": "2", "ro_b": "x", " ": "x"}
