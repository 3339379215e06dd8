import duckdb
import pytest

import corpus_pipeline
from quillstack.llm import decontaminate
from quillstack.llm.queries import QUERIES
from quillstack.plans.durable import durable

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = durable(stage(spark, docs, DATA))
        sizes.append(docs.count())
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 100
    whole = corpus_pipeline.run(spark, DATA)
    assert sorted(r["ids_sha256"] for r in whole.collect()) == sorted(r["ids_sha256"] for r in docs.collect())


def test_stages_take_edges(spark, edge, nothing):
    for df in (edge, nothing):
        docs = df
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = durable(stage(spark, docs, DATA))
            if i + 1 < len(corpus_pipeline.STAGES):
                assert docs.columns == df.columns
        assert docs.count() <= df.count()


def test_no_benchmark_is_left(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = durable(stage(spark, docs, DATA))
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert decontaminate.contamination(docs, bench).filter("contaminated").count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_queries_run_whole_tables(spark, name):
    table = {"op11_point_in_time": "labels", "op13_warc": "pages"}.get(name, "documents")
    count = "count(DISTINCT conv_id) + 1" if name == "op8_chat_format" else "count(*)"
    table = "conversations" if name == "op8_chat_format" else table
    n = duckdb.connect().execute(f"SELECT {count} FROM '{DATA}/{table}.parquet'").fetchall()[0][0]
    assert QUERIES[name](spark, DATA).count() == n
