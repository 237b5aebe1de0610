from collections import Counter

import pytest
from cases import empty, odd, prose
from pyspark.sql import functions as F

import corpus_pipeline
from corpus_pipeline import ORACLE_SQL, STAGES, run


@pytest.fixture(scope="module")
def stages():
    return dict(STAGES)


def test_stages_are_in_order(stages):
    assert list(stages) == ["language", "shared_lines", "near_copies", "benchmark_passages", "packing"]
    assert ORACLE_SQL is None


def test_all_but_the_last_keep_the_columns(spark, small, stages):
    docs = odd(spark)
    kept = {"language": {1, 2, 6, 7, 8, 9, None, 10, 12}}
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        rows = out.collect()
        assert all(r["score"] == "clash" and r["node"] == 9 for r in rows)
        if name in kept:
            assert {r["doc_id"] for r in rows} == kept[name]
        assert stage(spark, empty(spark), small).collect() == []
    assert stages["packing"](spark, empty(spark), small).collect() == []


def test_shared_lines_take_effect(spark, small, stages):
    rows = {r["doc_id"]: r for r in stages["shared_lines"](spark, odd(spark), small).collect()}
    assert 2 not in rows  # nothing was left of the copy
    assert prose(99, 70, "shared") not in rows[9]["text"]
    assert rows[9]["n_chars"] == len(rows[9]["text"])
    assert rows[4]["text"] == "" and rows[3]["text"] is None


def test_near_copies_leave_one(spark, small, stages):
    rows = stages["near_copies"](spark, odd(spark), small).collect()
    assert Counter(r["doc_id"] for r in rows)[1] == 1 and 2 not in {r["doc_id"] for r in rows}


def test_benchmark_passages_go(spark, small, stages):
    item = spark.read.parquet(f"{small}/benchmark.parquet").orderBy(F.length("text").desc()).first()
    docs = odd(spark)
    leak = docs.where("doc_id = 8").withColumn("text", F.lit(f"x {item['text']} y"))
    out = stages["benchmark_passages"](spark, docs.where("doc_id <> 8").unionByName(leak), small)
    assert 8 not in {r["doc_id"] for r in out.collect()} and out.count() == docs.where("doc_id <> 8 OR doc_id IS NULL").count() - docs.where("doc_id IS NULL").count()


def test_run_is_the_stages_in_turn(spark, small):
    rows = run(spark, small).collect()
    docs = corpus_pipeline.table(spark, small, "documents")
    for _, stage in STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, small), "step")
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
    assert 0 < docs.count() < spark.read.parquet(f"{small}/documents.parquet").count()


def test_columns_may_have_the_names_that_they_are_kept_under(spark):
    rows, back = corpus_pipeline._aside(
        spark.createDataFrame([(1, "a", "t", "b", "c")], "doc_id int, foo string, text string, kept_0 string, `kept.1` string")
    )
    assert back(rows).columns == ["doc_id", "foo", "text", "kept_0", "kept.1"]
    assert tuple(back(rows).first()) == (1, "a", "t", "b", "c")
