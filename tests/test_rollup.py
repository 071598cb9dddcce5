from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from frames import logs_frame
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions.quantiles import grouped_quantiles
from tidelog.operators import pairing, rollup

T0 = datetime(2026, 1, 1)
FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@FEW
@given(
    st.lists(
        st.tuples(
            st.sampled_from("ab"),
            st.one_of(st.none(), st.sampled_from([0.0, 1.0, 1.0, 499.5]), st.floats(-1e9, 1e9)),
        ),
        min_size=1,
        max_size=60,
    )
)
def test_quantiles_equal_numpy(spark, rows):
    frame = spark.createDataFrame(rows, "k string, v double")
    got = grouped_quantiles(
        frame, ["k"], "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99},
        counts={"ones": F.col("v") == 1.0, "rows": F.lit(True)}, maximum="top", counted="n",
    )
    for row in got.collect():
        values = [v for k, v in rows if k == row["k"] and v is not None]
        assert row["n"] == len(values) and row["rows"] == sum(k == row["k"] for k, _ in rows)
        assert row["ones"] == values.count(1.0)
        if not values:
            assert row["p50"] is None and row["top"] is None
            continue
        assert row["top"] == max(values)
        want = np.percentile(values, [50, 95, 99])
        assert [row["p50"], row["p95"], row["p99"]] == pytest.approx(list(want), rel=1e-9, abs=1e-6)


def test_hot_group_is_spread_and_input_is_shuffled_once(spark):
    frame = spark.range(200_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("k"),
        (F.pmod(F.hash("id"), F.lit(100_000)) / 7.0).alias("v"),
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = grouped_quantiles(frame, ["k"], "v", {"p50": 0.5, "p95": 0.95}, counted="n")
        rows = {r["k"]: r for r in got.collect()}
        plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = frame.groupBy("k").agg(F.percentile("v", [0.5, 0.95]).alias("p")).collect()
    for r in want:
        assert [rows[r["k"]]["p50"], rows[r["k"]]["p95"]] == pytest.approx(r["p"])
    assert "ReusedExchange" in plan


def brute_pairs(rows, gap):
    out = {}
    for _, ts, service, _, _, a in rows:
        if a.get("phase") != "end" or a.get("req_id") is None:
            continue
        starts = [
            (s_ts, number, s.get("route"))
            for number, s_ts, s_service, _, _, s in rows
            if s.get("phase") == "start" and s.get("req_id") == a["req_id"] and s_service == service
            and s_ts <= ts and ts - s_ts < timedelta(seconds=gap)
        ]
        if starts:
            best = max(starts)
            out[service, a["req_id"], ts] = ((ts - best[0]).total_seconds() * 1000, best[2])
    return out


@FEW
@given(
    st.lists(
        st.tuples(st.integers(0, 1500), st.sampled_from(["start", "end", None]), st.sampled_from(["r1", "r2", None]), st.sampled_from(["s1", "s2"])),
        min_size=1,
        max_size=40,
    )
)
def test_pairing_equals_brute_force(spark, drawn):
    rows = [
        (i, T0 + timedelta(seconds=s), service, "INFO", "b", {"phase": phase, "req_id": rid, "route": f"/{i}"})
        for i, (s, phase, rid, service) in enumerate(drawn)
    ]
    pairs = pairing.pair_requests(logs_frame(spark, rows), 300)
    got = {(r["service"], r["req_id"], r["ts"]): (r["gap_ms"], r["route"]) for r in pairs.collect()}
    assert got == brute_pairs(rows, 300)
    resolved = pairing.resolve(logs_frame(spark, rows), pairs)
    assert resolved.count() == len(rows)


def test_pairing_edges(spark):
    def at(seconds, number, phase, **more):
        return (number, T0 + timedelta(seconds=seconds), "s", "INFO", "b", {"phase": phase, "req_id": "x", **more})

    rows = [
        at(0, 1, "start", route="/a", method="GET"),
        at(300, 2, "end", status=200),  # exactly the gap: too old
        at(400, 3, "start", route="/b"),
        at(400, 4, "end", duration_ms=7.0, route="/own"),  # same moment pairs, own values win
        at(699.5, 5, "end"),
    ]
    logs = logs_frame(spark, rows)
    got = {r["ts"]: r for r in pairing.resolve_requests(logs).collect()}
    assert got[T0 + timedelta(seconds=300)]["dur"] is None
    assert got[T0 + timedelta(seconds=699.5)]["dur"] == 299500.0
    both = [r for r in pairing.resolve_requests(logs).collect() if r["ts"] == T0 + timedelta(seconds=400)]
    ended = next(r for r in both if r["phase"] == "end")
    assert (ended["dur"], ended["route"]) == (7.0, "/own")


def test_one_request_id_for_everything(spark):
    """A constant id on every line, many at one moment: the groups stay small."""
    moments = spark.range(20_000).select(
        F.col("id"),
        F.timestamp_micros(F.lit(1_767_225_600_000_000) + F.floor(F.col("id") / 100) * 1_000_000).alias("ts"),
        F.lit("h").alias("host"), F.lit("s").alias("service"), F.lit("INFO").alias("severity"),
        F.when(F.col("id") % 2 == 0, "start").otherwise("end").alias("phase"),
    )
    none = F.lit(None)
    logs = moments.select(
        "id", "ts", "host", "service", "severity",
        F.struct(
            none.cast("double").alias("duration_ms"), none.cast("int").alias("status"),
            none.cast("string").alias("method"), F.lit("/r").alias("route"),
            F.lit("unknown").alias("req_id"), F.col("phase"),
        ).alias("attrs"),
    )
    assert pairing.pair_requests(logs).count() == 200
    assert pairing.resolve_requests(logs).filter("dur = 0").count() == 10_000


def test_rollup_counts(spark):
    def line(number, seconds, severity, **attrs):
        return (number, T0 + timedelta(seconds=seconds), "s", severity, "b", attrs)

    rows = [
        line(1, 0, "INFO", duration_ms=500.0, status=200, route="/a", method="GET"),
        line(2, 1, "INFO", duration_ms=501.0, status=404, route="/a", method="GET"),
        line(3, 2, "ERROR", duration_ms=2001.0, status=200, route="/a"),
        line(4, 3, "FATAL"),
        line(5, 4, "WARN", duration_ms=2000.0, status=500, route="/a", method="GET", phase="start"),
        line(6, 300, "INFO", status=99, route="/b"),
    ]
    resolved = pairing.resolve_requests(logs_frame(spark, rows))
    by_bucket = {r["bucket"]: r for r in rollup.service_rollup(resolved).collect()}
    first = by_bucket[T0]
    want = dict(errors=2, warns=1, total=5, timed=4, req_errors=2, apdex_s=1, apdex_t=2, max_ms=2001.0)
    assert {k: first[k] for k in want} == want
    second = by_bucket[T0 + timedelta(minutes=5)]
    assert (second["total"], second["timed"], second["p50_ms"]) == (1, 0, None)
    ends = {(r["method"], r["route"]): r for r in rollup.endpoint_rollup(resolved).collect()}
    get = ends["GET", "/a"]
    assert (get["calls"], get["errors"], get["clienterr"], get["p50_ms"]) == (2, 0, 1, 500.5)
    assert ends["", "/a"]["errors"] == 1
    assert ends["", "/b"]["p95_ms"] is None
    hour = rollup.combine_rollups(rollup.service_rollup(resolved)).first()
    assert (hour["total"], hour["timed"], hour["apdex"]) == (6, 4, (1 + 2 / 2) / 4)


def test_quantiles_of_null_keys(spark):
    rows = [(None, "a", 1.0), (None, "a", 3.0), (None, None, 5.0), ("h", "a", 7.0), ("h", None, None)]
    df = spark.createDataFrame(rows, "host string, service string, v double")
    got = grouped_quantiles(df, ["host", "service"], "v", {"p50": 0.5}, maximum="top", counted="n")
    assert got.columns == ["host", "service", "p50", "top", "n"]
    assert {tuple(r) for r in got.collect()} == {
        (None, "a", 2.0, 3.0, 2), (None, None, 5.0, 5.0, 1), ("h", "a", 7.0, 7.0, 1), ("h", None, None, None, 0)
    }


def test_merged_sketches_keep_ranks(spark):
    rows = spark.range(60_000).select(
        (F.timestamp_seconds(F.col("id") % 7200 + 1767225600)).alias("ts"),
        F.concat(F.lit("h"), F.col("id") % 3).alias("host"),
        F.when(F.col("id") % 3 == 0, "one").otherwise("two").alias("service"),
        F.when(F.col("id") % 11 > 0, F.pmod(F.hash("id"), F.lit(9_000)) / 3.0).alias("dur"),
    )
    sketches = rollup.latency_sketches(rows)
    assert sketches.count() == 24 * 3
    at_once = rollup.merge_sketches(sketches, 86400, ("service",))
    twice = rollup.merge_sketches(rollup.merge_sketches(sketches, 3600), 86400, ("service",))
    values = {}
    for r in rows.filter("dur is not null").collect():
        values.setdefault(r["service"], []).append(r["dur"])
    for merged in (at_once, twice):
        for r in rollup.sketch_quantiles(merged).collect():
            own = np.array(values.pop(r["service"]) if merged is twice else values[r["service"]])
            assert (r["timed"], r["min_ms"], r["max_ms"]) == (len(own), own.min(), own.max())
            for name, q in rollup.QUANTILES.items():
                low, high = (own < r[name]).mean(), (own <= r[name]).mean()
                assert low - 3 * rollup.SKETCH_RANK_ERROR <= q <= high + 3 * rollup.SKETCH_RANK_ERROR
    assert not values
    few = rollup.sketch_quantiles(sketches.limit(0))
    assert few.columns == ["bucket", "host", "service", "timed", "min_ms", "max_ms", *rollup.QUANTILES] and few.count() == 0
