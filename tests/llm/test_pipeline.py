"""The pipeline and the registered queries."""

import pytest
from check_oracle import differences, duck

import corpus_pipeline
from corpuslens.llm import load_queries

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = load_queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_twins(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), duck(FOLDER), ORACLES[name]) is None


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_stages_keep_the_columns_and_decide(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / name)
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        stage(spark, docs, FOLDER).write.parquet(out)
        after = spark.read.parquet(out)
        ids = [r.doc_id for r in after.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= set(before)
        if place < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
            docs = after
        else:
            assert set(ids) == set(before)
    # What the stages left holds no near copies and no contaminated document.
    from corpuslens.llm import decontamination, ngram_join

    linked = ngram_join.linked_documents(docs)
    assert linked.where("id <> component_id").count() == 0
    hits = decontamination.benchmark_hits(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet"))
    assert hits.where(decontamination.contaminated()).count() == 0


def test_run_gives_the_rows_of_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < rows.count() <= 200


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, FOLDER).collect() == []
