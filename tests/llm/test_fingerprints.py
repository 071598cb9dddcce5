"""I-Match fingerprints: the edited text by plain Python, the lexicon by counting, likeness by cases."""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import fingerprints as I
from tidelog.llm.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DDL = "doc_id long, text string, hashes string, next_text string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 3) for r in rows], DDL)


def edited(rows):
    """(doc_id, text, edited text) in descending doc_id, nulls last, ties by text."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = []
    for (i, text), (_, following) in zip(rows, [*rows[1:], *rows[:1]]):
        half = len(text) // 2
        out.append((i, text, text[: len(text) - half] + following[:half]))
    return out


def prose(seed, count):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdef"), 3)) for _ in range(count))


ROWS = [
    *((k, prose(k, 5 + 3 * k)) for k in range(60)), (100, None), (101, ""), (102, " \n"), (103, "%%%"), (104, "Über ß日本 \U0001f600x"),
    (105, prose(3, 14)), (106, prose(1, 30_000)), (None, "no id"), (None, None), (-5, "one"), (7, "other text of seven"), (8, prose(8, 29)),
]


def test_edited_texts_and_lengths(spark):
    got = sorted(((r.doc_id, r.text, r.edited) for r in I.edited_fingerprints(table(spark, ROWS)).collect()), key=repr)
    assert got == sorted(edited(ROWS), key=repr)


def test_order_holds_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(I, "_BUCKET_ROWS", 3)
    monkeypatch.setattr(I, "_CUTS", 7)
    rows = [(k * k - 50, f"text {k} " * (k % 5)) for k in range(90)] + [(None, "z"), (10**15, "far"), (-(10**15), "far too")]
    got = sorted(((r.doc_id, r.text, r.edited) for r in I.edited_fingerprints(table(spark, rows)).collect()), key=repr)
    assert got == sorted(edited(rows), key=repr)


def test_equal_texts_and_likeness(spark):
    base = prose(11, 300).split()
    near = " ".join([*base[:290], *prose(12, 10).split()])
    rows = [(k, prose(k + 50, 200)) for k in range(40)] + [(900, " ".join(base)), (901, " ".join(base)), (902, near), (903, prose(13, 300))]
    docs = table(spark, rows)
    found = I.with_hashes(docs.select("doc_id", "text"), "text", "found", I.lexicon(docs, (0.0, 1.0)))
    by_id = {r.doc_id: r.found for r in found.collect()}
    pairs = [(by_id[900], by_id[k]) for k in (901, 902, 903)] + [([None] * I.SUBSETS, [None] * I.SUBSETS), (by_id[900], [None] * I.SUBSETS)]
    frame = spark.createDataFrame(pairs, "a array<long>, b array<long>")
    same, close, other, both_empty, one_empty = (r[0] for r in frame.select(I.likeness(F.col("a"), F.col("b"))).collect())
    assert same == both_empty == 1.0 and one_empty == 0.0 and other < close < 1.0
    printed = {r.doc_id: r.fingerprint for r in I.fingerprints(docs).collect()}
    assert printed[900] == printed[901] and len(set(printed.values())) == len(rows) - 1


def test_lexicon_is_the_band(spark):
    rows = [(k, " ".join(w for n, w in enumerate(("every", "half", "third", "tenth", "rare")) if k % (1, 2, 3, 10, 97)[n] == 0)) for k in range(100)]
    docs = table(spark, rows)
    counts = Counter(w for _, t in rows for w in set(re.findall(r"\w+", t)))
    lexicon = I.lexicon(docs, (0.05, 0.4))
    words = spark.createDataFrame([(w,) for w in counts], "w string")
    kept = words.where(F.size(F.filter(F.array(F.xxhash64("w")), lambda t: F.getbit(F.get(lexicon, I._word(t)), F.pmod(t, F.lit(64)).cast("int")) == 1)) > 0)
    assert {r.w for r in kept.collect()} == {w for w, n in counts.items() if 5 <= n <= 40}


def test_native_and_empty(spark):
    frame = I.edited_fingerprints(table(spark, ROWS))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert I.edited_fingerprints(table(spark, [])).collect() == []
    assert [tuple(r)[1:4] for r in I.edited_fingerprints(table(spark, [(1, "abcd")])).collect()] == [(4, "abcd", "abab")]


def test_query(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("benchmark tables not here")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e in edited(docs)}
    found = QUERIES["op13_fingerprints"](spark, SF_DIR).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in found} == want
    text = dict(docs)
    prints = {r.doc_id: r.fingerprint for r in found}
    assert len({(text[i], p) for i, p in prints.items()}) == len({t for t in text.values()})
    assert sum(r.near_edited for r in found) > 20 * sum(r.near_next for r in found)


def test_the_lexicon_is_not_written_into_plans(spark):
    frame = I.edited_fingerprints(table(spark, ROWS))
    plans = frame._jdf.queryExecution()
    for text in (plans.analyzed().toString(), plans.optimizedPlan().toString(), plans.executedPlan().toString()):
        assert len(text) < 200_000
