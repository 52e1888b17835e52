"""Corpus queries against their SQL, and the pipeline against a plain version of it."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from checks.compare import compare, views
from parlance.llm.oracle import ORACLE
from parlance.llm.queries import QUERIES
from tests.llm.test_llm_dedup import brute_classes

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_registered():
    assert set(QUERIES) < set(queries()) and "pipeline" in queries() and set(ORACLE) <= set(oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    good, note = compare(queries()[name](spark, SF), views(SF), ORACLE[name])
    assert good, note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"op13_gram_list_variants"}))
def test_query_has_every_row(spark, name):
    table = "pages" if name.startswith(("op1_", "op4_")) else "documents"
    assert queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stored(stage(spark, docs, SF))
        rows[name] = (before.collect(), docs.collect())
        if name != "packing":
            assert docs.columns == before.columns
    before, after = rows["quality rules"]
    kept = {r.doc_id for r in QUERIES["op8_quality_rules"](spark, SF).where("kept").collect()}
    assert {r.doc_id for r in after} == kept and len(after) == len(kept)
    before, after = rows["line dedup"]
    assert {r.doc_id for r in after} == kept
    before, after = rows["near dedup"]
    classes = brute_classes([(r.doc_id, r.text) for r in before], 5)
    assert {r.doc_id for r in after} == {i for i, _, c in classes if i == c}
    before, after = rows["source mix"]
    texts = {r.doc_id: r.text for r in before}
    assert all(texts[r.doc_id] == r.text for r in after)
    assert max(Counter(r.doc_id for r in after).values()) <= 2
    before, after = rows["packing"]
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after)


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF))
    assert docs.collect() == []


def test_run_reruns_alike(spark):
    a, b = (sorted(corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    assert a == b and a
