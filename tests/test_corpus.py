import pytest

from corpuslens.corpus import Corpus
from corpuslens.schemas import CASCADES, TABLES, schema_of


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))

    def save(name, rows, columns):
        schema = schema_of(name)
        full = [tuple(dict(zip(columns, row)).get(f.name) for f in schema.fields) for row in rows]
        spark.createDataFrame(full, schema).write.parquet(f"{root}/{name}")

    for name in TABLES:
        if name in CASCADES["android_firmware"] or name.endswith("Report") or name in ("android_firmware", "rq_job"):
            continue
        save(name, [], [])
    save("android_firmware", [("f1", "LG"), ("f2", "Sony"), ("f3", "LG")], ["id", "os_vendor"])
    save("android_app", [("a1", "f1", "x.apk"), ("a2", "f1", "y.apk"), ("a3", "f2", "z.apk")], ["id", "firmware_id_reference", "filename"])
    save("firmware_file", [("x1", "f1"), ("x2", "f2")], ["id", "firmware_id_reference"])
    save(
        "build_prop_file",
        [("p1", "f1", {"a": "1", "b": "2"}), ("p2", "f1", {"a": "1"}), ("p3", "f2", {"a": "3", "b": "9"})],
        ["id", "firmware_id_reference", "properties"],
    )
    for name in ("tlsh_hash", "ssdeep_hash"):
        save(name, [], [])
    for name in (n for n in TABLES if n.endswith("Report")):
        save(name, [(f"{name}1", "a1"), (f"{name}2", "gone")], ["id", "android_app_id_reference"])
    save("rq_job", [("j1", "q", "failed"), ("j2", "q", "finished"), ("j3", "r", "failed")], ["job_id", "queue", "status"])
    return Corpus(spark, root)


def ids(df):
    return sorted(r[0] for r in df.select(df.columns[0]).collect())


def test_list_queries(corpus):
    assert ids(corpus.firmware_ids({"os_vendor": "LG"})) == ["f1", "f3"]
    assert ids(corpus.firmware_page("f1", 1)) == ["f2"]
    assert ids(corpus.app_ids(["f1"])) == ["a1", "a2"]
    assert ids(corpus.app_ids()) == ["a1", "a2", "a3"]
    assert ids(corpus.property_files(keys=["a", "b"])) == ["p1", "p3"]
    assert ids(corpus.property_files(values=["9", "none"])) == ["p3"]
    assert ids(corpus.property_files(distinct_on="firmware_id_reference")) == ["p1", "p3"]
    assert ids(corpus.jobs(queue="q", status="failed")) == ["j1"]
    assert ids(corpus.jobs(ids=["j2", "j3"])) == ["j2", "j3"]
    with pytest.raises(ValueError):
        corpus.table("nope")


def test_report_union_reads_requested_types_only(corpus):
    everything = corpus.scan_reports()
    assert everything.count() == 26 and everything.select("report_type").distinct().count() == 13
    two = corpus.scan_reports(requested=["QarkReport", "ExodusReport"])
    assert two.count() == 4 and len({f.rsplit("/", 2)[1] for f in two.inputFiles()}) == 2


def test_dereference_and_cascade(corpus, spark):
    found = {(r["id"], r["app_filename"]) for r in corpus.reports_with_apps("ExodusReport").collect()}
    assert found == {("ExodusReport1", "x.apk"), ("ExodusReport2", None)}
    kept = corpus.without("android_firmware", spark.createDataFrame([("f1",)], "id string"))
    assert ids(kept["android_firmware"]) == ["f2", "f3"]
    assert ids(kept["android_app"]) == ["a3"] and ids(kept["build_prop_file"]) == ["p3"] and ids(kept["firmware_file"]) == ["x2"]


def test_views_read_what_is_asked_for(spark, tmp_path):
    """Filters and columns of a list query reach the scan of the table a view is over."""
    spark.range(20).selectExpr("id AS k", "CAST(id % 3 AS STRING) AS vendor", "'x' AS other").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    view = table.selectExpr("concat('f', k) AS id", "vendor AS os_vendor", "other AS original_filename")
    corpus = Corpus(spark, views={"android_firmware": view})
    found = corpus.list("android_firmware", filters={"os_vendor": "1"}, columns=["id"])
    assert ids(found) == sorted(f"f{k}" for k in range(20) if k % 3 == 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(vendor,1)" in plan and "ReadSchema: struct<k:bigint,vendor:string>" in plan
    with pytest.raises(ValueError, match="no table"):
        corpus.table("android_app")
