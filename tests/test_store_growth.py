"""Tables of many small ranges."""

from pyspark.sql import functions as F

from corpuslens import store as st


def test_small_buckets_are_written_by_few_tasks(spark, tmp_path):
    """Ranges of ten rows, more than a hundred of them, some cut where an id comes several times."""
    store = st.Store(spark, str(tmp_path))
    rows = spark.range(3000).select(F.floor(F.col("id") / 3).alias("id"), F.col("id").alias("v"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("small-buckets", "")
    try:
        store.create("t", rows, "id", bucket_rows=10)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("small-buckets") for s in tracker.getJobInfo(j).stageIds]
    buckets = store.tables()["t"].buckets
    assert len(buckets) > 200 and max(s.numTasks for s in stages if s) < len(buckets) / 2
    assert sum(b.rows for b in buckets) == 3000 and [b.first for b in buckets[1:]] == sorted({b.first for b in buckets[1:]})
    store.delete("t", spark.range(0, 1000, 7).select("id"))
    assert sorted(r.v for r in store.table("t").collect()) == [v for v in range(3000) if v // 3 % 7]
