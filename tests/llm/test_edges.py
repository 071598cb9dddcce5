"""Columns with the operators' own names, repeated rows of training texts, searches without queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, neighbours, ngram_join, quality
from tidelog.llm.common import training_rows


def prose(seed: int, count: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(count))


def test_clashing_columns_stay(spark):
    ddl = "doc_id long, text string, _d string, _h int, _D2 long, _score double, __score double"
    rows = [(k, prose(k, 30), f"d{k}", k, 2, 0.5 + k, 0.25) for k in range(12)] + [(50, prose(3, 30), "copy", 1, 2, 3.0, 4.0)]
    docs = spark.createDataFrame(rows, ddl)
    items = spark.createDataFrame([(1, prose(5, 30))], "item_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(12)], "doc_id long, quality int, toxic int")
    given = {r.doc_id: r for r in docs.collect()}
    clean = decontaminate.clean_documents(docs, items)
    assert clean.columns == docs.columns and {r.doc_id: r for r in clean.collect()} == {k: r for k, r in given.items() if k != 5}
    single = ngram_join.one_of_each(docs)
    assert single.columns == docs.columns and {r.doc_id: r for r in single.collect()} == {k: r for k, r in given.items() if k != 50}
    good = quality.good_documents(docs, labels)
    assert good.columns == docs.columns and all(given[r.doc_id] == r for r in good.collect())


def test_training_rows_are_bounded_where_documents_repeat(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    docs = docs.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(200)))).drop("n")
    labels = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    rows = training_rows(docs, labels, "toxic", 5)
    assert len(rows) == 10 and len({r[0] for r in rows}) == 10


def test_neighbours_without_queries(spark):
    rows = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(1, 9)], "vec_id long, embedding array<float>")
    assert neighbours.nearest_neighbours(rows, F.col("vec_id") % 20 == 0).collect() == []
