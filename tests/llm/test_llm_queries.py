"""Registered training-data queries against SQL, and the pipeline against its stages."""

from __future__ import annotations

import os

import oracle
import pytest

import corpus_pipeline
from tidelog.llm.queries import ORACLES, QUERIES
from tidelog.llm.quality import score_quality

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="benchmark tables not here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = oracle.connect(SF_DIR)
    assert oracle.difference(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) is None


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    good = {r.doc_id for r in score_quality(docs, labels).collect() if r.predicted}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF_DIR)
        assert now.columns == docs.columns, name
    left = {r.doc_id for r in now.collect()}
    con = oracle.connect(SF_DIR)
    con.execute(f"CREATE TEMP TABLE good AS SELECT * FROM documents WHERE doc_id IN ({','.join(map(str, good))})")
    groups = ORACLES["op8_ngram_join"].replace("documents", "good")
    con.execute(f"CREATE TEMP TABLE kept AS SELECT DISTINCT component_id AS doc_id FROM ({groups})")
    leaks = {r[0] for r in con.execute(f"SELECT DISTINCT doc_id FROM ({ORACLES['op4_decontamination']})").fetchall()}
    want = {r[0] for r in con.execute("SELECT doc_id FROM kept").fetchall()} - leaks
    assert left == want
    pieces = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id for r in pieces} == want
    total = {r.doc_id: r.doc_tokens for r in pieces}
    assert sum(r.length for r in pieces) == sum(total.values())
