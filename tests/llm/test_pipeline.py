"""The pipeline on the smallest tables, and the queries with SQL twins."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import decontaminate, near_dedup
from tessella.llm.queries import QUERIES, SQL
from tessella.sources.shared import materialize
from tests.llm.corpus import documents


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = materialize(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        kept[name] = {r.doc_id for r in docs.collect()}
    assert kept["near_dedup"] < kept["toxicity"] and kept["decontamination"] <= kept["near_dedup"]
    assert near_dedup.near_duplicates(docs).where(~F.col("kept")).count() == 0
    assert decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
    out = corpus_pipeline.STAGES[4][1](spark, materialize(corpus_pipeline.STAGES[3][1](spark, docs, sf_dir)), sf_dir)
    assert out.columns == [*columns, "shard", "slot"] and out.count() > 0


def test_stages_survive_awkward_rows(spark, sf_dir):
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    assert {"doc_id", "text", "row", "score", "shard", "slot"} <= set(docs.columns)
    empty = documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = materialize(stage(spark, empty, sf_dir))
    assert empty.count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(name, spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    res = con.execute(SQL[name])
    names = [d[0] for d in res.description]
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in res.fetchall()), key=repr)
    assert got == want


def test_query_names():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
