from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

import corpus_pipeline

DIR = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, DIR), name)
        assert out.schema.names == docs.schema.names and 0 < out.count() <= docs.count()
        docs = out
    assert docs.count() < before
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_a_result_outlives_later_stages(spark):
    """A stage drops no table that an unread result needs, whoever runs meanwhile."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = corpus_pipeline.best_fit(spark, docs, DIR)
    before = out.count()
    corpus_pipeline.pseudonyms(spark, docs, DIR).count()
    corpus_pipeline.best_fit(spark, docs, DIR).count()
    assert out.count() == before


def test_two_runs_at_once_agree(spark):
    with ThreadPoolExecutor(2) as pool:
        runs = list(pool.map(lambda _: {tuple(r) for r in corpus_pipeline.run(spark, DIR).select("doc_id", "piece", "length", "ids_crc32").collect()}, range(2)))
    assert runs[0] == runs[1] and runs[0]


def test_stages_of_odd_and_empty_documents(spark, odd, none):
    for docs in (odd.withColumns({c: F.lit("x") for c in ("row", "g", "x", "s", "distance", "keys", "component_id", "cell", "rank", "before")}), none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = corpus_pipeline.written(stage(spark, docs, DIR), name)
            assert out.schema.names == docs.schema.names and out.count() <= docs.count()
            docs = out
        assert corpus_pipeline.best_fit(spark, docs, DIR).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
