"""Hard negatives against every pair."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import hard_negatives as H
from tidelog.llm.streams import map_records

DDL = "vec_id long, embedding array<float>, label int, block long, low string, at int"


def plain(rows):
    """Every pair of rows, in whole numbers."""
    seen, given = set(), []
    for vec_id, vector, label, *_ in rows:
        if label is None or not vector or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = tuple(math.floor(256 * float(np.float32(x))) for x in vector)
        if max(map(abs, whole)) > 2**27 or (vec_id, label, whole) in seen:
            continue
        seen.add((vec_id, label, whole))
        given.append((vec_id, label, whole))
    out = []
    last = lambda x: math.inf if x is None else x
    for anchor, label, vector in given:
        if anchor is None or anchor % 100:
            continue
        scored = [
            (sum(a * b for a, b in zip(vector, v)), i, lab == label) for i, lab, v in given if i != anchor and len(v) == len(vector)
        ]
        scored.sort(key=lambda s: (-s[0], last(s[1])))
        for positive, positive_id, _ in [s for s in scored if s[2]][:5]:
            window = [s for s in scored if not s[2] and 30 * positive <= 100 * s[0] <= 90 * positive]
            out += [(anchor, positive_id, n + 1, s[1], positive, s[0]) for n, s in enumerate(window[:10])]
    return sorted(out, key=repr)


def found(spark, rows):
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DDL)
    got = H.hard_negatives(table, lambda ids: ids % 100 == 0).collect()
    return sorted((tuple(r) for r in got), key=repr)


def test_curve_visits_every_cell_by_single_steps():
    for bits, dims in ((3, 2), (2, 3), (4, 1)):
        cells = np.indices((1 << bits,) * dims).reshape(dims, -1).T
        keys = H.hilbert_keys(cells, bits)
        order = np.argsort(keys)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_equals_all_pairs(spark, spread):
    rng = np.random.default_rng(int(spread * 100))
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(1500):
        vector = centres[i % 6] + spread * rng.normal(size=8)
        rows.append((i, [float(x) for x in vector], int(rng.integers(3))))
    rows += [(2000 + i, [1.0] * 8, i % 2) for i in range(600)]  # one vector, ties by id
    rows += [rows[7]] * 30 + [(None, [0.5] * 8, 1), (100, [0.25] * 8, 2), (5000, [1e9] * 8, 1)]
    rows += [(9000, None, 1), (9100, [1.0, None], 1), (9200, [float("nan")] * 8, 1), (9300, [], 1), (9400, [1.0] * 8, None)]
    rows += [(9500, [0.0] * 8, 1), (9600, [1.0, 2.0], 0), (9601, [2.0, 1.0], 0), (9602, [1.5, 0.5], 1), (9603, [0.7, 0.6], 1)]
    assert found(spark, rows) == plain(rows)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.integers(-400_000, 400_000, 6)], i % 2) for i in range(300)]
    assert found(spark, rows) == plain(rows)


def test_bounds_leave_blocks_unread(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 8))
    rows = [(i, [float(x) for x in centres[i % 40] + 0.01 * rng.normal(size=8)], i % 2) for i in range(12_000)]
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DDL)
    given = table.select("vec_id", F.col("label").cast("long").alias("label"), H.scaled(F.col("embedding")).alias("whole"))
    blocks = H.candidate_blocks(given.withColumn("dims", F.size("whole")))
    zones = [(np.frombuffer(r.low, "<i4"), np.frombuffer(r.high, "<i4")) for r in blocks.collect()]
    rows_in = blocks.select("dims", "ids", "labels", "vectors").collect()
    chunks = map_records(blocks, H._chunks(lambda ids: ids % 100 == 0), H._CHUNK).collect()
    read = total = 0
    for chunk in chunks:
        for anchor in np.frombuffer(chunk.vectors, "<i4").reshape(-1, 8).astype(np.int64):
            least, most = H._bounds(anchor[None], *(np.stack(z).astype(np.int64) for z in zip(*zones)))
            scores = [np.frombuffer(r.vectors, "<i4").reshape(-1, 8) @ anchor for r in rows_in]
            assert all(a <= s.min() and s.max() <= b for a, s, b in zip(least[0], scores, most[0]))
            best = np.sort(np.concatenate(scores))[-6]
            read += (most[0] >= best).sum()
            total += len(zones)
    assert read < 0.5 * total


def test_nothing_to_search(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 1), (2, [1.0], 0)]) == []
    assert found(spark, [(100, [1.0], 1)]) == []
