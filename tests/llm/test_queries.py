"""Registered queries against their SQL, and the pipeline against a plain run of its rules."""

import hashlib

import pytest

import __spark_entry__
import corpus_pipeline
from folio.llm import decontam, langid, line_dedup, ngram_join, queries
from tests import oracle


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    assert oracle.of_spark(queries.queries()[name](spark, data)) == oracle.of_sql(oracle.connection(data), queries.oracle_sql()[name])


def test_all_are_registered():
    assert {*queries.queries(), "pipeline"} <= set(__spark_entry__.queries())


def test_pipeline_keeps_what_its_rules_keep(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    left = {}
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        current.createOrReplaceTempView("before")
        out = stage(spark, current, data)
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        current = spark.read.parquet(path)
        left[name] = current
        if name != "pack":
            assert current.columns == docs.columns
    pred = {r.doc_id: r.lang_pred for r in langid.identify_language(docs).collect()}
    assert {r.doc_id for r in left["language"].collect()} == {i for i, p in pred.items() if p != "und"}
    report = {r.doc_id: r.kept_sha256 for r in line_dedup.line_report(left["language"]).collect()}
    assert {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in left["lines"].collect()} == report
    links = ngram_join.jaccard_join(left["lines"], words=5, percent=80).collect()
    assert {r.doc_id for r in left["near_copies"].collect()} == {r.doc_id for r in links if not r.n_shingles or r.doc_id == r.component_id}
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    clean = {r.doc_id for r in decontam.decontaminate(left["near_copies"], items).collect() if not r.contaminated}
    assert {r.doc_id for r in left["benchmark"].collect()} == clean
    assert {r.doc_id for r in left["pack"].collect()} == clean
    assert oracle.of_spark(corpus_pipeline.run(spark, data).select("doc_id", "piece", "length")) == oracle.of_spark(left["pack"].select("doc_id", "piece", "length"))
