"""The stages one by one on their own input, and the whole."""

import corpus_pipeline
import pytest
from oracle import SF
from pyspark.sql import functions as F

from meridex.llm import decontam, ngrams
from test_corpus_queries import ODD, empty, odd  # noqa: F401


def test_order_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]


def test_each_stage_keeps_columns_and_its_decisions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, SF)
        if k < 4:
            assert docs.columns == columns
            docs.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
            assert docs.join(before, "doc_id", "left_anti").isEmpty() and docs.count() > 100
        if k == 2:
            again = ngrams.classes(docs)
            assert again.where("component_id <> doc_id").isEmpty()
        if k == 3:
            assert decontam.mark(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where(F.size("contamination") > 0).isEmpty()
            kept = docs.select("doc_id")
    assert docs.select("doc_id").distinct().count() == kept.count()


def test_whole(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


@pytest.mark.parametrize("k", range(5))
def test_odd_and_empty(spark, odd, empty, k):  # noqa: F811
    stage = corpus_pipeline.STAGES[k][1]
    assert stage(spark, spark.read.parquet(f"{empty}/documents.parquet"), empty).collect() == []
    out = stage(spark, spark.read.parquet(f"{odd}/documents.parquet"), odd).collect()
    assert len(out) <= len(ODD) if k < 4 else len(out) >= len(ODD)
