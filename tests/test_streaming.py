"""A stream gives the same tables as a batch over the same files."""

from __future__ import annotations

import glob
import os
import random
from datetime import datetime, timedelta

import pytest
from frames import logs_frame
from pyspark.sql import functions as F

from tidelog.operators import pairing, parse, rollup, serve
from tidelog.plans.store import Store
from tidelog.sources import files, ingest
from tidelog.streaming import pipeline

T0 = datetime(2026, 1, 10, 12)


def write_file(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def line(seconds, text):
    stamp = (T0 + timedelta(seconds=seconds)).strftime("%Y-%m-%d %H:%M:%S.%f")[:-3]
    return f"[{stamp}] {text}"


def some_lines(offset):
    out = []
    for i in range(12):
        s = offset + i * 70
        out.append(line(s, f"incoming request url=/u/{i}?x=1 method=GET request_id=req-{i:06d}"))
        out.append(line(s + 3, f"request completed statusCode={200 + 300 * (i % 2)} request_id=req-{i:06d}"))
        if i % 3 == 0:
            out.append(line(s + 4, f"ERROR no connection {i}"))
            out.append("    at connect (net.js)")
    return out


def run_stream(spark, folder, store, checkpoint):
    raw = files.read_lines(spark, f"{folder}/*.log", streaming=True, max_files_per_trigger=1)
    query = pipeline.ingest_stream(raw, store, checkpoint, host="h1", multiline=True, every=None)
    query.awaitTermination()


def test_stream_equals_batch_and_replays_leave_nothing(spark, tmp_path):
    folder, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    write_file(folder, "web-out.log", some_lines(0))
    write_file(folder, "api-out.log", some_lines(5))
    run_stream(spark, folder, store, str(tmp_path / "cp"))
    # Late lines in a second run, a part of them delivered before.
    write_file(folder, "web-out__2026-01-10_00-00-00.log", some_lines(0)[:9] + [line(50, "late WARN")])
    run_stream(spark, folder, store, str(tmp_path / "cp"))

    def delivered(name):
        records = pipeline.assembled(files.read_lines(spark, f"{folder}/{name}.log"))
        parsed = parse.parse_logs(records, host="h1", origin=ingest.origin(records))
        return ingest.to_log_rows(parsed)

    rows = ingest.merge_deliveries(*map(delivered, ("web-out", "api-out", "web-out__2026-01-10_00-00-00"))).drop("origin")
    columns = ["ts", "service", "severity", "body", "fp", "id"]
    assert sorted(map(repr, store.read("log_entries").select(columns).collect())) == sorted(
        map(repr, rows.select(columns).collect())
    )
    resolved = pairing.resolve_requests(rows)
    for table, build in (("log_rollup", rollup.service_rollup), ("endpoint_rollup", rollup.endpoint_rollup)):
        want = build(resolved)
        got = store.read(table).select(*want.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    errors = rows.filter(F.col("severity") == "ERROR").count()
    assert store.read("error_groups").agg(F.sum("occurrences")).first()[0] == errors == 8
    assert "\n    at connect" in rows.filter(F.col("severity") == "ERROR").first()["body"]

    # The same files again with a lost checkpoint: nothing is stored twice.
    before = store.read("log_entries").count()
    rollups = sorted(map(repr, store.read("log_rollup").collect()))
    run_stream(spark, folder, store, str(tmp_path / "cp2"))
    assert store.read("log_entries").count() == before
    assert sorted(map(repr, store.read("log_rollup").collect())) == rollups
    assert store.read("error_groups").agg(F.sum("occurrences")).first()[0] == errors


def test_append_stream_keeps_equal_lines_and_takes_none_twice(spark, tmp_path):
    folder = tmp_path / "in"
    write_file(folder, "a-out.log", [line(1, "x"), line(1, "x"), line(2, "y")])
    write_file(folder, "a-out-1.log", [line(1, "x"), line(3, "z")])
    raw = files.read_lines(spark, f"{folder}/*.log", streaming=True, max_files_per_trigger=1)
    rows = ingest.to_log_rows(parse.parse_logs(raw, host="h", origin=ingest.origin(raw)))
    out = str(tmp_path / "out")
    for run in ("cp", "cp2"):  # the second time all files are new again
        pipeline.append_stream(rows, out, str(tmp_path / run), every=None).awaitTermination()
    stored = spark.read.parquet(out)
    assert sorted(r["body"][-1] for r in stored.collect()) == ["x", "x", "x", "y", "z"]
    assert "day" in stored.columns


def test_pairs_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    pick = random.Random(3)

    def requests(low, high, count):
        rows = []
        for _ in range(count):
            facts = {"req_id": pick.choice(["a", "b", "c", None]), "phase": pick.choice(["start", "end", None])}
            facts["route"] = f"/{pick.randint(0, 9)}"
            ts = T0 + timedelta(seconds=pick.randint(low, high))
            rows.append((pick.randint(0, 10**6), ts, pick.choice(["web", "api"]), "INFO", "", facts))
        return rows

    # Out of order within the delay; a start that comes after its end; an end whose start is too old.
    batches = [requests(0, 400, 60), requests(250, 900, 60), requests(700, 5000, 60)]
    batches[1].append((1, T0 + timedelta(seconds=300), "late", "INFO", "", {"req_id": "x", "phase": "end"}))
    batches[2].append((2, T0 + timedelta(seconds=290), "late", "INFO", "", {"req_id": "x", "phase": "start"}))
    batches[2].append((3, T0 + timedelta(seconds=890), "late", "INFO", "", {"req_id": "x", "phase": "end"}))
    last = (0, T0 + timedelta(days=9), "web", "INFO", "", {"req_id": "z", "phase": "end"})
    schema = logs_frame(spark, [last]).schema
    # The watermark follows the latest row: the third batch starts 100 s behind the second's end.
    for rows in [*batches, [last], [(9, *last[1:])]]:
        logs_frame(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        raw = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        pairs = pipeline.paired_stream(raw, 300, "11 minutes", unpaired=True)
        writer = pairs.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        writer.start(str(tmp_path / "out")).awaitTermination()
    every = [row for rows in batches for row in rows]
    want = pairing.pair_requests(logs_frame(spark, every), 300)
    out = spark.read.parquet(str(tmp_path / "out"))
    got = out.filter("gap_ms IS NOT NULL").select(*want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert ("late", 10.0) in {(r["service"], r["gap_ms"] / 1000) for r in got.collect()}
    ends = {(r[2], r[5]["req_id"], r[1]) for r in every if r[5]["phase"] == "end" and r[5]["req_id"]}
    assert {(r["service"], r["req_id"], r["ts"]) for r in out.collect()} == ends
    assert out.count() == len(ends)


def test_state_partitions_follow_the_cores_not_the_batch_shuffles(spark):
    from tidelog.plans import QUERIES
    from tidelog.session import shared_dir

    name, sf_dir = "spark.sql.shuffle.partitions", "/root/testdata/sf0.001"
    if not os.path.isdir(sf_dir):
        pytest.skip("benchmark tables not here")
    pattern = f"{shared_dir(spark).removeprefix('file:')}/stores/*/progress/state/[0-3]/[0-9]*"
    known, before = set(glob.glob(pattern)), spark.conf.get(name)
    spark.conf.set(name, "24")
    try:
        pairs = QUERIES["streamed_pairs"](spark, sf_dir)
        assert spark.conf.get(name) == "24"
        want = QUERIES["request_pairs"](spark, sf_dir).select(*pairs.columns)
        assert sorted(map(repr, pairs.collect())) == sorted(map(repr, want.collect()))
    finally:
        spark.conf.set(name, before)
    state = set(glob.glob(pattern)) - known
    assert len(state) == 4 * spark.sparkContext.defaultParallelism < 4 * 24

    with pipeline.state_partitions(spark, 3):
        assert spark.conf.get(name) == "3"
    with pytest.raises(KeyError), pipeline.state_partitions(spark):
        raise KeyError
    assert spark.conf.get(name) == before


def test_live_counts_and_tail(spark, tmp_path):
    folder = tmp_path / "in"
    write_file(folder, "web-out.log", [line(1, "ERROR a"), line(2, "b"), line(301, "WARN c")])
    write_file(folder, "web-out__2026-01-09_00-00-00.log", [line(4, "archived")])
    write_file(folder, "api-out.log", [line(1, "d")])
    raw = files.read_lines(spark, f"{folder}/*.log", streaming=True)
    counts = pipeline.live_counts(parse.parse_logs(raw, host="h"))
    query = counts.writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = {(r["service"], r["bucket"]): (r["total"], r["errors"], r["warns"]) for r in spark.table("live").collect()}
    assert rows == {("web", T0): (3, 1, 0), ("web", T0 + timedelta(minutes=5)): (1, 0, 1), ("api", T0): (1, 0, 0)}

    tail = serve.tail_stream(parse.service_and_kind(raw), ["we"])
    query = tail.writeStream.format("memory").queryName("tail").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["message"][-1] for r in spark.table("tail").collect()) == ["a", "b", "c"]
