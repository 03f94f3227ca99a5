"""Five stages over ``documents``: each reads what the one before it wrote, its decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslens.llm import stages
from corpuslens.session import new_work_dir

# Every stage takes (spark, docs, sf_dir); all but the last give back the columns of documents.
STAGES = [
    ("toxicity", stages.toxicity_stage),
    ("line_dedup", stages.line_dedup_stage),
    ("ngram_join", stages.ngram_join_stage),
    ("benchmark_decontamination", stages.decontamination_stage),
    ("bpe_codec", stages.bpe_codec_stage),
]

ORACLE_SQL = None  # the stages are tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage is written as Parquet and read again by the next."""
    folder = sf_dir.rstrip("/")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES:
        path = new_work_dir(spark, name)
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
