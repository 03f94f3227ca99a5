"""The stages of the corpus pipeline: one operator each, whose decisions change the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, line_dedup, ngram_join, queries, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. The label rows are those of the operator's own query."""
    return toxicity.without_toxic(docs, queries.toxicity_model(docs, _table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_shared_lines(docs)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, _table(spark, sf_dir, "benchmark"))


def bpe_codec_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: ids and decoded texts as digests, one row per document that is left."""
    return queries.coded(docs)
