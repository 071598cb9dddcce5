from __future__ import annotations

import os
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidelog.sources import files, ingest, tables


def expected_records(text):
    records, open_record = [], False
    for line in text.split("\n"):
        if line == "":
            continue
        if re.match(r"\s", line) and open_record:
            records[-1] += "\n" + line
        else:
            open_record = bool(re.match(r"\S", line))
            records.append(line)
    return records


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 32768])
def test_records_across_chunks(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(files, "_CHUNK_LINES", chunk)
    texts = {
        "a.log": "  lead 1\n  lead 2\nfirst\n  at x\n\n  at y\nsecond\nthird\n" + "  more\n" * 6 + "last\n",
        "b.log": "\n".join(f"line {i}" if i % 4 else f"\tcont {i}" for i in range(40)),
        "c.log": "   only indented\n   twice",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    # Small splits: one file is read by several tasks.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        lines = files.number_lines(files.read_lines(spark, f"{tmp_path}/*.log"))
        rows = files.assemble_records(lines).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, text in texts.items():
        mine = sorted(
            (r["block"], r["chunk"], r["part"], r["message"]) for r in rows if r["file"].endswith(name)
        )
        assert sorted(m[3] for m in mine) == sorted(expected_records(text))


def test_lines_carry_their_path_and_old_files_are_skipped(spark, tmp_path):
    (tmp_path / "new app-out.log").write_text("x\n")
    (tmp_path / "old-out.log").write_text("y\n")
    os.utime(tmp_path / "old-out.log", (1_000_000_000, 1_000_000_000))
    os.utime(tmp_path / "new app-out.log", (1_700_000_000, 1_700_000_000))
    every = files.read_lines(spark, f"{tmp_path}/*.log")
    assert {r["file"] for r in every.collect()} == {
        f"{tmp_path}/new app-out.log", f"{tmp_path}/old-out.log",
    }
    as_of = "2023-11-14T22:20:00"  # 1,700,000,000 is 22:13:20
    fresh = files.read_recent_lines(spark, f"{tmp_path}/*.log", as_of, files.PM2_MAX_AGE_SECONDS)
    assert [r["message"] for r in fresh.collect()] == ["x"]
    assert [r["message"] for r in files.recent_only(every, as_of, 900).collect()] == ["x"]


def test_container_and_journal_sources(spark, tmp_path):
    (tmp_path / "c.json").write_text(
        '{"message":"a","container_name":"web"}\n{"message":"b","container_name":"logs-db"}\n'
    )
    (tmp_path / "j.json").write_text('{"message":"c","_SYSTEMD_UNIT":"ssh.service","PRIORITY":"6"}\n')
    containers = files.read_container_json(spark, f"{tmp_path}/c.json", exclude=["logs-db"])
    journal = files.read_journal_json(spark, f"{tmp_path}/j.json")
    rows = files.union_sources(containers, journal).collect()
    assert sorted((r["message"], r["container_name"], r["_SYSTEMD_UNIT"]) for r in rows) == [
        ("a", "web", None), ("c", None, "ssh.service"),
    ]


def test_ndjson_one_bad_line_costs_one_line(spark):
    lines = [
        '{"ts":"2026-01-01T00:00:00Z","service":"s","body":"b","attrs":{"status":200,"duration_ms":1.5}}',
        "", "   ", "{bad", "[1]", "5", '{"message":"m\\r"}', '{"attrs":{}}', '{"attrs":{"status":"20x"}}',
    ]
    frame = spark.createDataFrame([(x,) for x in lines], "value string")
    events, rejects = files.read_ndjson(frame)
    assert sorted(r["line"] for r in rejects.collect()) == ["5", "[1]", "{bad"]
    rows = ingest.to_log_rows(events, "edge").collect()
    full = next(r for r in rows if r["service"] == "s")
    assert full["attrs"]["status"] == 200 and full["attrs"]["duration_ms"] == 1.5
    assert full["host"] == "edge" and full["kind"] == "unknown" and full["id"] > 0
    plain = next(r for r in rows if r["body"] == "m")
    assert plain["service"] == "unknown" and plain["ts"] is None and plain["attrs"] is None
    assert next(r for r in rows if r["attrs"] and r["service"] == "unknown")["attrs"]["status"] is None
    dated, undated = ingest.split_undated(ingest.to_log_rows(events))
    assert dated.count() == 1 and undated.count() == 3


def _rows(spark, bodies):
    events = spark.createDataFrame(
        [(f"2026-01-0{1 + i % 3}T00:00:0{i % 10}", "s", b) for i, b in enumerate(bodies)],
        "ts string, service string, body string",
    )
    return ingest.to_log_rows(events)


def test_stored_duplicates_are_absorbed(spark, tmp_path):
    path = str(tmp_path / "logs")
    rows = _rows(spark, ["a", "b", "c", "a"])
    tables.ingest_rows(spark, rows, path)
    tables.ingest_rows(spark, rows, path)
    tables.ingest_rows(spark, _rows(spark, ["a", "b", "c", "a", "new"]), path)
    stored = tables.read_table(spark, path, "log_entries")
    assert sorted(r["body"] for r in stored.collect()) == ["a", "a", "b", "c", "new"]
    assert [d.isoformat() for d in tables.list_days(spark, path)] == [
        "2026-01-01", "2026-01-02", "2026-01-03",
    ]
    sizes = {str(r["day"]): r["bytes"] for r in tables.partition_sizes(spark, path).collect()}
    assert set(sizes) == {"2026-01-01", "2026-01-02", "2026-01-03"} and min(sizes.values()) > 0


def _bodies(spark, path):
    return sorted(r["body"] for r in tables.read_table(spark, path, "log_entries").collect())


def test_equal_lines_of_a_delivery_all_stay(spark, tmp_path):
    path = str(tmp_path / "logs")
    line = [("2026-01-01T00:00:00", h, "s", "same", o) for h, o in (("h1", "a"), ("h1", "a"), ("h2", "a"), ("h1", "b"))]
    events = spark.createDataFrame(line, "ts string, host string, service string, body string, origin string")
    rows = ingest.to_log_rows(events)
    for delivery in (rows.limit(1), rows, rows):
        tables.ingest_rows(spark, delivery, path)
    stored = tables.read_table(spark, path, "log_entries").collect()
    assert len(stored) == 4 == len({r["id"] for r in stored})
    tables.ingest_rows(spark, rows.unionByName(rows), path)  # a delivery that really holds more
    assert len(_bodies(spark, path)) == 8


def test_ingest_that_broke_off_is_made_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "logs")
    rows = _rows(spark, ["a", "b"]).unionByName(_rows(spark, ["a", "b"]))
    write = tables.write_logs

    def after_the_rows(fresh, where):
        write(fresh, where)
        raise OSError("lost here")

    monkeypatch.setattr(tables, "write_logs", after_the_rows)
    with pytest.raises(OSError):
        tables.ingest_rows(spark, rows, path)
    monkeypatch.setattr(tables, "write_logs", write)
    for _ in range(2):
        tables.ingest_rows(spark, rows, path)
        assert _bodies(spark, path) == ["a", "a", "b", "b"]


def test_ingest_reads_the_ledger_of_its_days_only(spark, tmp_path):
    path = str(tmp_path / "logs")
    tables.ingest_rows(spark, _rows(spark, ["a", "b", "c"]), path)
    known = tables._known_copies(spark, path, [date(2026, 1, 2)])
    assert known.count() == 1 and "PartitionFilters: [isnotnull(day" in known._jdf.queryExecution().executedPlan().toString()


def test_upsert_rewrites_only_touched_days(spark, tmp_path):
    path = str(tmp_path / "t")
    ddl = "bucket timestamp, fp string, occurrences bigint"

    def frame(*rows):
        df = spark.createDataFrame([(f"2026-01-0{d} 00:05:00", f, n) for d, f, n in rows], ddl.replace("timestamp", "string"))
        return df.withColumn("bucket", F.col("bucket").cast("timestamp"))

    tables.upsert_days(spark, path, "error_group_bucket", frame((1, "x", 1), (1, "y", 1), (2, "x", 1)))
    before = {f: os.stat(f"{path}/day=2026-01-02/{f}").st_mtime_ns for f in os.listdir(f"{path}/day=2026-01-02")}
    tables.upsert_days(spark, path, "error_group_bucket", frame((1, "x", 5), (1, "z", 2)))
    after = {f: os.stat(f"{path}/day=2026-01-02/{f}").st_mtime_ns for f in os.listdir(f"{path}/day=2026-01-02")}
    assert before == after
    rows = tables.read_table(spark, path, "error_group_bucket").collect()
    assert sorted((r["day"].day, r["fp"], r["occurrences"]) for r in rows) == [
        (1, "x", 5), (1, "y", 1), (1, "z", 2), (2, "x", 1),
    ]


def test_day_predicate_prunes_partitions(spark, tmp_path):
    from tidelog.functions.timing import time_range

    path = str(tmp_path / "logs")
    tables.write_logs(_rows(spark, ["a", "b", "c"]), path)
    stored = tables.read_table(spark, path, "log_entries")
    plan = time_range(stored, "2026-01-02", "2026-01-02 12:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: [IsNotNull(ts)" in plan


def test_days_of_any_century_are_listed(spark, tmp_path):
    for name in ("day=1970-01-01", "day=2024-01-05", "day=__HIVE_DEFAULT_PARTITION__", "_temporary"):
        (tmp_path / name).mkdir()
    assert [str(d) for d in tables.list_days(spark, str(tmp_path))] == ["1970-01-01", "2024-01-05"]


def test_container_without_name_is_not_excluded(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"message": "a"}\n{"message": "b", "container_name": "store"}\n')
    rows = files.read_container_json(spark, str(tmp_path / "c.json"), exclude=["store"]).collect()
    assert [r.message for r in rows] == ["a"]


def test_size_beyond_a_long_counts_as_nothing(spark):
    from tidelog.functions.text import size_bytes

    rows = spark.createDataFrame([("1.5KiB",), ("9" * 400 + "GiB",)], "t string")
    assert [r[0] for r in rows.select(size_bytes(F.col("t"))).collect()] == [1536, 0]


def test_infinite_duration_is_none(spark):
    from tidelog.operators.pairing import _own_duration

    rows = spark.createDataFrame([((float("inf"),),), ((float("nan"),),), ((2.0,),)], "attrs struct<duration_ms: double>")
    assert [r[0] for r in rows.select(_own_duration()).collect()] == [None, None, 2.0]


def test_more_lines_are_spread_over_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(files, "ROWS_A_TASK", 10, raising=False)
    lines = spark.range(0, 195, 1, 8)
    assert files.spread_out(lines).rdd.getNumPartitions() == 20
    assert files.spread_out(spark.range(0, 5, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
