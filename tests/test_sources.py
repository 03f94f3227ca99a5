import json
import os
import time

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import properties, reports
from corpuslens.operators.rules import manifest_findings
from corpuslens.sources import files, sinks, tree
from corpuslens.sources import reports as report_sources
from corpuslens.streaming import flows, progress


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)


def test_file_inventory(spark, tmp_path):
    write(tmp_path / "root/system/app/X.apk", b"app")
    write(tmp_path / "root/system/build.prop", b"a=1")
    write(tmp_path / "root/top.txt", b"")
    for name in (".dot.txt", "_under.txt", "system/._system.img", ".hid/x.txt"):
        write(tmp_path / "root" / name, b"x")
    (tmp_path / "root/empty/deeper").mkdir(parents=True)
    (tmp_path / "root/system/up").symlink_to(tmp_path / "root")
    write(tmp_path / "root/a b/\u00e9 %41.txt", b"x")
    rows = {r["relative_path"]: r for r in files.file_inventory(spark, str(tmp_path / "root"), "system").collect()}
    hidden = {"/.dot.txt", "/_under.txt", "/system/._system.img", "/.hid", "/.hid/x.txt", "/empty", "/empty/deeper"}
    assert set(rows) == hidden | {
        "/system", "/system/app", "/system/app/X.apk", "/system/build.prop", "/top.txt", "/a b", "/a b/\u00e9 %41.txt", "/system/up"
    }
    assert rows["/empty/deeper"]["is_directory"] and rows["/.hid/x.txt"]["md5"] == "9dd4e461268c8034f5c8564e155c67a6"
    assert rows["/system"]["is_directory"] and rows["/system"]["md5"] is None and rows["/system"]["parent_dir"] == "/"
    app = rows["/system/app/X.apk"]
    assert (app["name"], app["parent_dir"], app["size"], app["is_directory"]) == ("X.apk", "app", 3, False)
    assert rows["/top.txt"]["parent_dir"] == "/" and rows["/top.txt"]["md5"] == "d41d8cd98f00b204e9800998ecf8427e"


def listed(tree, root):
    return sorted((r["path"][len(str(root)) :], r["is_directory"], r["size"]) for r in tree.collect())


def test_a_tree_is_shared_out_among_tasks(spark, tmp_path):
    want = []
    for a in range(5):
        want.append((f"/{a}", True, None))
        for b in range(a):
            want += [(f"/{a}/{b}", True, None), (f"/{a}/{b}/f{b}.img", False, b), (f"/{a}/{b}/deep", True, None)]
            write(tmp_path / f"{a}/{b}/f{b}.img", b"x" * b)
            (tmp_path / f"{a}/{b}/deep").mkdir()
    (tmp_path / "0").mkdir()
    for folders in (1, 3, 8, 500):  # from one task that walks everything to all levels opened while planning
        tree.register(spark)
        reader = spark.read.format("file_tree").option("folders", str(folders))
        assert listed(reader.load(str(tmp_path)), tmp_path) == sorted(want)
    assert reader.load(str(tmp_path)).rdd.getNumPartitions() > 1
    assert listed(reader.option("recursive", "false").load(str(tmp_path)), tmp_path) == [(f"/{a}", True, None) for a in range(5)]
    only = reader.option("recursive", "true").option("glob", "f[23].*").load(f"file://{tmp_path}").where("NOT is_directory")
    assert listed(only, tmp_path) == [(f"/{a}/{b}/f{b}.img", False, b) for a in range(5) for b in range(a) if b in (2, 3)]
    with pytest.raises(Exception):
        reader.load(str(tmp_path / "missing")).collect()


def test_a_stream_gives_each_file_once(spark, tmp_path, monkeypatch):
    folder, log = tmp_path / "in", tmp_path / "log"

    def run():
        files.watch_tree(spark, str(folder), str(log)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "checkpoint")
        ).trigger(availableNow=True).start().awaitTermination()
        return sorted(os.path.basename(r["path"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    write(folder / "a", b"1")
    write(folder / "sub/b", b"22")
    assert run() == ["a", "b"] and run() == ["a", "b"]
    os.rename(folder / "sub", folder / "moved")  # other paths: new files
    write(folder / "a", b"changed")
    assert run() == ["a", "a", "b", "b"]
    # An entry that Spark has not asked for yet when the stream stops is given after the restart.
    write(folder / "c", b"3")
    reader = tree.TreeStreamReader(str(folder), True, None, str(log))
    end = reader.latestOffset()
    assert end == reader.latestOffset() and len(reader.partitions({"entry": end["entry"] - 1}, end)) == 1
    assert reader.partitions(end, end) == []
    write(folder / "d", b"4")
    assert run() == ["a", "a", "b", "b", "c", "d"]
    # Many files of one entry are many partitions; no more than their own rows is read for one.
    monkeypatch.setattr(tree, "LOG_ROWS", 3)
    for i in range(8):
        write(folder / f"n{i}", b"5")
    reader = tree.TreeStreamReader(str(folder), True, None, str(log))
    start, end = {"entry": tree.Log(str(log)).entries()}, reader.latestOffset()
    parts = [b.num_rows for p in reader.partitions(start, end) for b in reader.read(p)]
    assert parts == [3, 3, 2]


def test_a_stream_needs_a_log(spark, tmp_path):
    tree.register(spark)
    with pytest.raises(Exception, match="log"):
        spark.readStream.format("file_tree").load(str(tmp_path)).writeStream.format("noop").start().awaitTermination()


def test_import_folder_and_loose_apps(spark, tmp_path):
    for name in ("a.zip", "b.txt", "c.tar.gz", "d.APK", "e.apk"):
        write(tmp_path / name, name.encode())
    write(tmp_path / "deep/f.zip", b"f")
    assert {r["name"] for r in files.import_candidates(spark, str(tmp_path)).collect()} == {"a.zip", "c.tar.gz"}
    assert {r["name"] for r in files.loose_apps(spark, str(tmp_path)).collect()} == {"d.APK", "e.apk"}


def test_last_line_wins_in_files(spark, tmp_path):
    lines = [f"filler{i}=x" for i in range(2000)]
    write(tmp_path / "p/build.prop", "\n".join(["ro.a=first", *lines, "ro.a=last", "q=1=2"]).encode())
    rows = properties.property_rows(files.line_rows(spark, str(tmp_path), "*.prop"))
    maps = properties.property_maps(rows, "file_path", "line_no").first()["properties"]
    assert maps["ro_a"] == "last" and len(maps) == 2001
    known = rows.select("file_path").distinct().unionByName(spark.createDataFrame([("none",)], "file_path string"))
    found = properties.property_maps(rows, "file_path", "line_no", known).where("file_path = 'none'").first()
    assert list(found["properties"]) == ["error"]


def test_reports_and_rules(spark, tmp_path):
    write(tmp_path / "r/one.json", b'{"a": 1}')
    write(tmp_path / "r/two.json", b"{broken")
    found = {r["scan_status"] for r in report_sources.read_report_files(spark, str(tmp_path / "r")).collect()}
    assert found == {"completed", "failed"}
    rule = {"crime": "c", "permission": [], "api": [{"class": "C", "method": "m", "descriptor": "()V"}] * 2, "score": 1, "label": []}
    write(tmp_path / "rules/1.json", json.dumps(rule, indent=4).encode())
    loaded = report_sources.read_rules(spark, str(tmp_path / "rules")).first()
    assert loaded["crime"] == "c" and len(loaded["api"]) == 2
    assert report_sources.builtin_rules(spark).count() == 14


def test_match_report_shape(spark):
    payload = {
        "apkid_version": "2.1.0", "rules_sha256": "0",
        "files": [
            {"filename": "a.apk", "matches": {"file_type": ["APK"]}},
            {"filename": "a.apk!classes.dex", "matches": {"anti_vm": ["x", "y"], "compiler": ["dx"]}},
        ],
    }
    df = spark.createDataFrame([(1, json.dumps(payload)), (2, "{}")], "id int, results string")
    found = {(r["category"], r["match"]) for r in reports.match_findings(df, "id", "results").collect()}
    assert found == {("file_type", "APK"), ("anti_vm", "x"), ("anti_vm", "y"), ("compiler", "dx")}


def test_privacy_report_shape(spark):
    payload = [{"application_information": [["n", ["v"]]]}, {"analysis_results": [["location_lookup", ["a", "b"]], ["code_execution", []]]}]
    df = spark.createDataFrame([(1, json.dumps(payload))], "id int, results string")
    found = {(r["category"], r["entry"]) for r in reports.privacy_findings(df, "id", "results").collect()}
    assert found == {("location_lookup", "a"), ("location_lookup", "b")}


def test_manifest(spark):
    xml = (
        '<manifest xmlns:android="http://schemas.android.com/apk/res/android" package="com.x">'
        '<application android:debuggable="true"><activity android:name="A" android:exported="true"><intent-filter/></activity>'
        '<activity android:name="B" android:exported="true"/><receiver android:name="R" android:exported="true"/>'
        "</application></manifest>"
    )
    apps = spark.createDataFrame([("1", xml), ("2", "<broken")], "id string, xml string")
    components = report_sources.manifest_components(apps, "id", "xml")
    assert components.where("app_id = '1'").count() == 4
    found = {(r["checker"], r["name"]) for r in manifest_findings(components).collect()}
    assert ("CWE489", "com.x") in found and ("CWE925", "R") in found
    assert not any(name == "B" for _, name in found)
    checked = spark.createDataFrame([("1", "R")], "app_id string, name string")
    assert "CWE925" not in {r["checker"] for r in manifest_findings(components, checked).collect()}


def test_sinks(spark, tmp_path):
    modules = spark.createDataFrame([("m1", "vendor"), ("m2", "system"), ("m3", "odm")], "module string, part string")
    sinks.write_module_lists(modules, str(tmp_path / "meta"), "module", "part")
    lines = (tmp_path / "meta/meta_group=vendor").glob("*.txt")
    assert sorted("".join(f.read_text() for f in lines).splitlines()) == ["    m1 \\", "    m3 \\"]
    logs = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS ts, 'LOUD' AS level, 'x' AS message")
    for _ in range(2):
        sinks.append_log(logs, str(tmp_path / "log"), ["scan"])
    stored = spark.read.parquet(str(tmp_path / "log"))
    assert stored.count() == 2 and stored.first()["level"] == "INFO" and stored.first()["tags"] == ["scan"]


# --- streams -------------------------------------------------------------------------------


def test_watch_imports(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder / "a.zip", b"one")
    write(folder / "b.zip", b"one")
    write(folder / "c.zip", b"two")
    write(folder / "d.txt", b"three")
    known = spark.createDataFrame([("known",)], "text string").select(F.md5("text").alias("md5"))
    write(folder / "e.zip", b"known")
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")

    def run():
        flows.import_new(flows.watch_imports(spark, str(folder), "*.zip", str(tmp_path / "log")), known, table)(checkpoint).awaitTermination()
        return spark.read.parquet(table).collect()

    found = run()
    assert len(found) == 2 and {r["size"] for r in found} == {3}
    # A file with an old time of its own is new all the same; content of the first batch is not.
    write(folder / "old.zip", b"older")
    os.utime(folder / "old.zip", (time.time() - 30 * 86400,) * 2)
    write(folder / "again.zip", b"one")
    assert sorted(r["size"] for r in run()) == [3, 3, 5]


def test_fan_out_queues_an_app_once_over_batches(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / n) for n in ("s", "t", "c"))
    done = spark.createDataFrame([(9,)], "app_id long")
    for ids in ([1, 2, 2, 9], [2, 3]):
        spark.createDataFrame([(i,) for i in ids], "app_id long").coalesce(1).write.mode("append").parquet(source)
        arrivals = spark.readStream.schema("app_id long").parquet(source)
        flows.fan_out(arrivals, done, "app_id", "TEXT", table)(checkpoint).awaitTermination()
    assert sorted(r["app_id"] for r in spark.read.parquet(table).collect()) == [1, 2, 3]


def test_log_windows_drop_late_rows_and_match_batch(spark, tmp_path):
    def logs(name, days):
        rows = ", ".join(f"(timestamp'2024-01-{d:02d} 06:00:00', 'INFO', 'scan')" for d in days)
        spark.sql(f"SELECT * FROM VALUES {rows} AS t(ts, level, tag)").coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    logs("s", [1, 1, 2, 3, 9])
    schema = spark.read.parquet(str(tmp_path / "s")).schema
    streamed = flows.run_once(spark, flows.log_windows(spark.readStream.schema(schema).parquet(str(tmp_path / "s"))), "log")
    found = {(str(r["window_start"])[:10], r["n"]) for r in streamed.collect()}
    assert found == {("2024-01-01", 2), ("2024-01-02", 1), ("2024-01-03", 1)}
    batch = flows.log_windows(spark.read.parquet(str(tmp_path / "s"))).collect()
    assert found <= {(str(r["window_start"])[:10], r["n"]) for r in batch}


def test_scan_progress_over_several_batches(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = [("a", 1, "queued"), ("a", 2, "started"), ("b", 3, "queued"), ("a", 4, "finished"), ("b", 5, "failed")]
    for app, n, status in rows:
        spark.sql(f"SELECT '{app}' AS app_id, timestamp_seconds({n}) AS ts, {n} AS event_id, '{status}' AS status").coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    updates = flows.run_once(spark, flows.scan_progress(stream), "progress", "update")
    assert updates.select("batch").distinct().count() > 1
    found = {(r["app_id"], r["status"], r["changes"]) for r in flows.latest_per_key(updates, "app_id").collect()}
    assert found == {("a", "finished", 3), ("b", "failed", 2)}


def test_retention(spark):
    logs = spark.sql("SELECT * FROM VALUES (timestamp'2024-01-01', 1), (timestamp'2024-01-09', 2), (timestamp'2024-01-10', 3) AS t(ts, id)")
    kept = flows.retained(logs, F.lit("2024-01-16").cast("timestamp"))
    assert {r["id"] for r in kept.collect()} == {2, 3}


def test_progress_lets_go_of_old_apps(spark, tmp_path):
    """State equals the apps under way and those that ended lately; an app that comes back starts anew."""
    days = [
        [("a", 1, "queued"), ("b", 1, "queued"), ("c", 1, "started"), (None, 1, "queued")],
        [("a", 2, "finished"), ("b", 3, "started"), ("b", 3, "failed"), ("c", 0, "late")],
        [("c", 6, "started"), ("d", 6, "queued")],
        [("d", 14, "started")],  # the watermark passes the end of a and b
        [("d", 15, "started"), ("a", 15, "queued")],
        [("d", 40, "finished")],  # and the silence of c and a
        [("d", 41, "finished")],
    ]
    schema = "app_id string, ts timestamp, event_id long, status string"
    for n, rows in enumerate(days):
        values = ", ".join(f"({'NULL' if a is None else repr(a)}, timestamp_seconds({d * 86400}), {10 * n + i}L, '{s}')" for i, (a, d, s) in enumerate(rows))
        spark.sql(f"SELECT * FROM VALUES {values} AS t(app_id, ts, event_id, status)").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        os.utime(tmp_path / f"in/{n}")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    seen = []

    def write_batch(batch, number):
        seen.append(sorted(((r.app_id or "", r.status, r.changes) for r in batch.collect())))

    with progress.timers(spark):
        stream = progress.bounded_progress(events, delay="0 seconds", keep="7 days", idle="20 days")
        query = stream.writeStream.foreachBatch(write_batch).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    seen = [rows for rows in seen if rows]
    assert seen == [
        [("", "queued", 1), ("a", "queued", 1), ("b", "queued", 1), ("c", "started", 1)],
        [("a", "finished", 2), ("b", "failed", 3)],  # what is older than the watermark is late
        [("c", "started", 2), ("d", "queued", 1)],
        [("d", "started", 2)],
        [("a", "queued", 1), ("d", "started", 3)],
        [("d", "finished", 4)],
        [("d", "finished", 5)],
    ]
    left = spark.read.format("statestore").option("stateVarName", "latest").load(str(tmp_path / "c"))
    assert {r.key.app_id for r in left.select("key").collect()} == {"d"}
