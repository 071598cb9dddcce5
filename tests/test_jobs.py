from __future__ import annotations

import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelog import schemas
from tidelog.operators import alerts, diagnose, metrics, pairing, retention, rollup, serve
from tidelog.plans import jobs, standins
from tidelog.plans.store import Store
from tidelog.sources import ingest, tables

T0 = datetime(2026, 1, 10, 12)


def rows_of(spark, *lines):
    """(seconds after T0, service, severity, body, attrs json) as log rows."""
    data = [((T0 + timedelta(seconds=s)).isoformat(), svc, sev, body, a) for s, svc, sev, body, a in lines]
    events = spark.createDataFrame(data, "ts string, service string, severity string, body string, attrs string")
    return ingest.to_log_rows(events, "h1")


def start(s, rid="req-000001"):
    return (s, "web", "INFO", f"start {s}", f'{{"phase":"start","req_id":"{rid}","route":"/a","method":"GET"}}')


def end(s, rid="req-000001"):
    return (s, "web", "INFO", f"end {s}", f'{{"phase":"end","req_id":"{rid}","status":200}}')


def snapshot(store):
    names = ["log_rollup", "endpoint_rollup", "error_group_bucket", "error_groups"]
    return {n: sorted(map(repr, store.read(n).collect())) for n in names}


def test_rollup_job_is_idempotent_and_takes_in_late_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    lines = [start(10), end(20), (30, "web", "ERROR", "boom 1", None), (400, "web", "ERROR", "boom 2", None)]
    tables.ingest_rows(spark, rows_of(spark, *lines), store.path("log_entries"))
    as_of = T0 + timedelta(minutes=8, seconds=37)  # not on a bucket edge
    jobs.run_rollup(store, as_of)
    first = snapshot(store)
    jobs.run_rollup(store, as_of)
    assert snapshot(store) == first
    group = store.read("error_groups").first()
    assert (group["occurrences"], group["state"], group["sample"]) == (2, "open", "boom 2")

    # Resolved stays resolved while nothing new happens, and reopens with a late line.
    store.replace("error_groups", store.read("error_groups").withColumn("state", F.lit("resolved")))
    jobs.run_rollup(store, as_of)
    assert store.read("error_groups").first()["state"] == "resolved"
    late = [(40, "web", "ERROR", "boom 3", None), start(299, "req-000002"), end(301, "req-000002")]
    tables.ingest_rows(spark, rows_of(spark, *late), store.path("log_entries"))
    jobs.run_rollup(store, as_of)
    group = store.read("error_groups").first()
    assert (group["occurrences"], group["state"], group["sample"]) == (3, "open", "boom 2")
    # A pair across a bucket edge, and no partial count in the oldest bucket of a later run.
    whole = rollup.service_rollup(pairing.resolve_requests(store.read("log_entries")))
    jobs.run_rollup(store, T0 + timedelta(minutes=19))  # trailing range starts inside the first bucket
    got = {r["bucket"]: (r["total"], r["timed"], r["p50_ms"]) for r in store.read("log_rollup").collect()}
    assert got == {r["bucket"]: (r["total"], r["timed"], r["p50_ms"]) for r in whole.collect()}
    assert got[T0 + timedelta(minutes=5)][1:] == (1, 2000.0)


def test_backfill_equals_one_pass_and_keeps_other_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    lines = [x for d in range(3) for x in (start(d * 86400 + 5), end(d * 86400 + 9))]
    tables.ingest_rows(spark, rows_of(spark, *lines), store.path("log_entries"))
    jobs.run_rollup(store, T0 + timedelta(days=2, hours=1), backfill_days=3)
    assert store.read("log_rollup").count() == 3
    jobs.recompute(store, [T0, T0 + timedelta(days=2)])  # buckets with a hole between them
    assert sorted(r["timed"] for r in store.read("log_rollup").collect()) == [1, 1, 1]
    assert jobs.bucket_list(T0 + timedelta(seconds=1), T0 + timedelta(seconds=301)) == [
        b.astimezone() for b in (T0, T0 + timedelta(minutes=5))
    ]


def test_alert_job(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    spark.createDataFrame([], schemas.schema("alert_rules"))
    store.replace("alert_rules", alerts.seed_default_rules(store.read("alert_rules")))
    lines = [(i, "web", "ERROR", f"boom at line {i}", None) for i in range(30)]
    tables.ingest_rows(spark, rows_of(spark, *lines), store.path("log_entries"))
    now = T0 + timedelta(minutes=1)
    done = jobs.run_alerts(store, now, "hub")
    assert sorted(done.evaluated) == list(range(1, 10)) and not done.failures
    jobs.run_alerts(store, now + timedelta(minutes=1), "hub")
    jobs.run_alerts(store, now + timedelta(hours=1), "hub")
    events = store.read("alert_events").orderBy("ts").collect()
    assert [(e["rule_id"], e["service"], e["value"], e["state"]) for e in events] == [
        (1, "web", 30.0, "firing"), (1, "web", None, "resolved"),
    ]
    assert [r["state"] for r in store.read("alert_state").collect()] == ["resolved"]


def test_condition_that_fails_while_running_costs_its_own_rules_only(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.replace("alert_rules", alerts.seed_default_rules(store.read("alert_rules")))
    lines = [(i, "web", "ERROR", f"boom at line {i}", None) for i in range(30)]
    tables.ingest_rows(spark, rows_of(spark, *lines), store.path("log_entries"))
    bad = {r["id"] for r in store.read("alert_rules").filter("kind = 'error_rate'").collect()}
    jobs.run_alerts(store, T0 + timedelta(minutes=1), "hub")
    before = sorted(map(repr, store.read("alert_state").collect()))

    def broken(given, window, as_of):
        rows = given["log_entries"].select(F.col("service").alias("key"))
        return rows.withColumn("value", F.raise_error(F.lit("no such unit")).cast("double"))

    monkeypatch.setitem(alerts.CONDITIONS, "error_rate", broken)
    done = jobs.run_alerts(store, T0 + timedelta(hours=1), "hub")
    assert set(done.failures) == bad and all("no such unit" in text for text in done.failures.values())
    assert done.evaluated and not bad & set(done.evaluated)
    assert sorted(map(repr, store.read("alert_state").collect())) == before


def test_backfill_of_days_whose_counts_are_gone_adds_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    days = [-40, -31, -29, 0]
    lines = [(d * 86400 + i, "web", "ERROR", "boom", None) for d in days for i in range(3)]
    tables.ingest_rows(spark, rows_of(spark, *lines), store.path("log_entries"))
    every = jobs.bucket_list(T0 - timedelta(days=41), T0 + timedelta(minutes=5))
    jobs.recompute(store, every)
    jobs.run_retention(store, T0)
    assert len(tables.list_days(spark, store.path("error_group_bucket"))) == 2
    before = snapshot(store)
    jobs.recompute(store, every)
    assert snapshot(store) == before
    assert [r["occurrences"] for r in store.read("error_groups").collect()] == [12]
    # Open days still count what comes late.
    more = [*lines, (-29 * 86400 + 9, "web", "ERROR", "boom", None)]
    seen = tables.ingest_rows(spark, rows_of(spark, *more), store.path("log_entries"))
    jobs.recompute(store, jobs.touched_buckets(seen))
    assert [r["occurrences"] for r in store.read("error_groups").collect()] == [13]


def test_compaction_keeps_rows_and_ledger(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    path = store.path("log_entries")
    lines = [(i, "web", "INFO", f"line {i % 7}", None) for i in range(12)] + [(-86400, "web", "INFO", "old", None)]
    for n in range(len(lines)):
        tables.ingest_rows(spark, rows_of(spark, lines[n]), path)
    tables.write_logs(rows_of(spark, (99, "api", "INFO", "no key", None)), path)

    def rows():
        return sorted(map(repr, store.read("log_entries").collect()))

    def files(where):
        return {r["day"].day: r["files"] for r in tables.partition_sizes(spark, where).collect()}

    before, entries = rows(), files(tables._ledger(path))[10]
    assert files(path) == {9: 1, 10: 13}
    assert jobs.run_compaction(store, before=T0)["log_entries"] == []
    assert jobs.run_compaction(store)["log_entries"] == [date(2026, 1, 10)]
    assert files(path) == {9: 1, 10: 1} and rows() == before
    assert files(tables._ledger(path))[10] <= min(16, entries)
    # The ledger still knows every line.
    tables.ingest_rows(spark, rows_of(spark, *lines), path)
    assert rows() == before
    assert jobs.run_compaction(store)["log_entries"] == []


def test_retention_job(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    lines = [(-d * 86400, "web", "INFO", f"day {d}", None) for d in range(5)]
    tables.ingest_rows(spark, rows_of(spark, *lines), store.path("log_entries"))
    spark.createDataFrame(
        [(T0 - timedelta(days=d), "purge", "x") for d in (1, 91)], schemas.schema("maintenance_log")
    ).write.parquet(store.path("maintenance_log"))
    assert jobs.run_retention(store, T0).count() == 0  # 0 days keeps everything
    entries = jobs.run_retention(store, T0, log_days=2)
    assert sorted(r["detail"] for r in entries.collect()) == ["log_entries 2026-01-06", "log_entries 2026-01-07"]
    assert [d.day for d in tables.list_days(spark, store.path("log_entries"))] == [8, 9, 10]
    kept = sorted(r["action"] for r in store.read("maintenance_log").collect())
    assert kept == ["drop_partition", "drop_partition", "purge"]
    with pytest.raises(ValueError, match="unknown maintenance action"):
        retention.audit_rows(spark, T0, [("rm", "x")])


def test_purge_by_predicate(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    lines = [(0, "a", "INFO", "1", None), (1, "b", "INFO", "2", None), (86400, "b", "INFO", "3", None)]
    path = store.path("log_entries")
    tables.ingest_rows(spark, rows_of(spark, *lines), path)
    retention.purge(spark, path, "log_entries", F.col("service") == "b")
    assert [r["body"] for r in store.read("log_entries").collect()] == ["1"]
    assert tables.list_days(spark, path) == [date(2026, 1, 10)]


def test_pressure_plan_tiers(spark):
    days = [("h", "log_entries", date(2026, 1, d)) for d in (3, 1, 2)]
    parts = spark.createDataFrame(days, "host string, tbl string, day date")
    want = {20: [], 14: ["emergency_drop 1"], 9: ["emergency_drop 1", "emergency_drop 2"], 7: ["paused None"]}
    for pct, plan in want.items():
        free = spark.createDataFrame([("h", pct)], "host string, free_pct int")
        rows = retention.pressure_plan(parts, free).collect()
        assert sorted(f"{r['action']} {r['day'] and r['day'].day}" for r in rows) == plan


def test_paging_walks_over_every_row_once(spark):
    same = [(i, T0 + timedelta(seconds=i // 3)) for i in range(20)]
    logs = spark.createDataFrame(same, "id bigint, ts timestamp")
    seen, edge = [], (None, None)
    while True:
        rows = serve.page(logs, *edge, limit=7).collect()
        if not rows:
            break
        seen += [r["id"] for r in rows]
        edge = (rows[-1]["ts"], rows[-1]["id"])
    assert seen == list(range(19, -1, -1))


def test_json_forms(spark):
    listing = spark.createDataFrame([(2, None), (1, "x")], "a int, b string").orderBy("a")
    assert serve.json_array(listing, 5).first()["json"] == '[{"a":1,"b":"x"},{"a":2,"b":null}]'
    assert serve.json_array(listing.filter("a > 5"), 5).first()["json"] == "[]"
    assert serve.json_rows(listing).count() == 2


def test_certificate_days_are_cut_toward_zero(spark):
    probed = spark.createDataFrame(
        [("a", "h", T0 + timedelta(hours=47), "x" * 200), ("b", "h", T0 - timedelta(hours=1), "i"), ("c", "h", None, None)],
        "domain string, host string, not_after timestamp, issuer string",
    )
    rows = {r["domain"]: r for r in metrics.certificate_checks(probed, T0).collect()}
    assert (rows["a"]["days_left"], len(rows["a"]["issuer"])) == (1, 100)
    assert rows["b"]["days_left"] == 0
    assert (rows["c"]["days_left"], rows["c"]["error"]) == (None, "unreachable")


def test_sizes_and_health(spark):
    stats = spark.createDataFrame(
        [(T0, "h", v) for v in ("a|1.5%|1.5GiB / 2GiB", "db|1%|1MB / 2", "b||10 KB / 1", "c|2%|n/a / 1", "noise")],
        "ts timestamp, host string, value string",
    )
    status = spark.createDataFrame([("h", "a|Up (unhealthy)"), ("h", "b|Up (healthy)"), ("h", "zzz")], "host string, value string")
    rows = metrics.container_metrics(stats, metrics.container_health(status), skip="db").collect()
    assert {r["service"]: (r["cpu"], r["mem_bytes"], r["status"]) for r in rows} == {
        "a": (1.5, 1610612736, "unhealthy"), "b": (0.0, 10000, "healthy"), "c": (2.0, 0, "running"),
    }


def test_verdicts_of_files(spark):
    now = T0
    files = spark.createDataFrame(
        [("s1", "/1", 10, now, 1), ("s2", "/2", 10, now, 2), ("s3", "/3", 10, now, 3), ("s4", "/4", 10, now, 4), ("s5", "/5", 9, now - timedelta(hours=1), 5)],
        "service string, path string, size bigint, mtime timestamp, inode bigint",
    )
    positions = spark.createDataFrame([(1, 11), (2, 5), (4, 99), (5, 99)], "inode bigint, position bigint")
    selected = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "service string")
    rows = diagnose.file_verdicts(files, positions, selected, now).collect()
    assert {r["service"]: r["verdict"] for r in rows} == {
        "s1": "STALLED", "s2": "collected", "s3": "collected, no checkpoint yet", "s4": "DROPPED",
    }
    assert {r["service"] for r in diagnose.stalled_positions(files, positions, now).collect()} == {"s1", "s4"}
    logs = rows_of(spark, (0, "s1", "INFO", "x", None))
    silent = diagnose.silent_while_writing(selected, logs, files, now)
    assert {r["service"] for r in silent.collect()} == {"s2", "s3"}
    assert diagnose.silent_while_writing(selected, logs, files, now, collector_up_seconds=60).count() == 0
    early = diagnose.selected_activity(selected, logs, files, selected.limit(0), now, 100).collect()
    assert {r["service"]: r["verdict"] for r in early} == {"s1": "collected", "s2": "too early to judge", "s3": "too early to judge"}
    assert diagnose.rollup_lag(logs, spark.createDataFrame([], "bucket timestamp")).first()["verdict"] == "never"


def test_positions_do_not_hang_on_the_order_of_their_rows(spark, tmp_path):
    prices = [(1, 0.7), (1, 0.1), (1, 0.2), (2, 84197.04), (2, 0.95)]  # 0.9999999999999999 as doubles
    lines = spark.createDataFrame(prices, "l_orderkey bigint, l_extendedprice double")
    lines.coalesce(1).sortWithinPartitions(F.desc("l_extendedprice")).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = standins.view(spark, str(tmp_path), "positions").collect()
    assert {r["inode"]: r["position"] for r in found} == {1: 1, 2: 84197}


def test_a_day_without_rows_is_dropped_when_its_buckets_are_replaced(spark, tmp_path):
    path, name = str(tmp_path / "t"), "error_group_bucket"
    first, second = datetime(2026, 1, 9, 12), datetime(2026, 1, 10, 12)
    columns = [f for f in schemas.schema(name).fields if f.name != "day"]

    def counts(*buckets):
        rows = spark.createDataFrame([("f", b, 1) for b in buckets], "fp string, bucket timestamp, occurrences bigint")
        return rows.select(*[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in columns
        ])

    tables.replace_buckets(spark, path, name, counts(first, second), counts(first, second).select("bucket"))
    assert tables.read_table(spark, path, name).count() == 2
    tables.replace_buckets(spark, path, name, counts(second), counts(first, second).select("bucket"))
    assert [r["bucket"] for r in tables.read_table(spark, path, name).collect()] == [second]
    assert tables.list_days(spark, path) == [second.date()]


def test_versions_are_published_whole_and_old_ones_go(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    root = store.path("cert_expiry")
    rows = [("d", "h", T0, 1, "i", T0, None)]
    for n in range(5):
        frame = spark.createDataFrame(rows * (n + 1), schemas.schema("cert_expiry"))
        staged = tables.stage_version(frame, root)
        assert store.read("cert_expiry").count() == n  # not visible yet
        tables.publish_version(spark, root, staged)
        assert store.read("cert_expiry").count() == n + 1
    assert len(tables._versions(spark, root)) == 5  # a query may still read any of them
    staged = tables.stage_version(store.read("cert_expiry"), root)
    tables.publish_version(spark, root, staged, keep_seconds=0)
    assert len(tables._versions(spark, root)) == tables.KEPT_VERSIONS


def test_buckets_prune_days_on_the_executors(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    lines = [x for d in range(4) for x in (start(d * 86400 + 5), end(d * 86400 + 9))]
    seen = tables.ingest_rows(spark, rows_of(spark, *lines), store.path("log_entries"))
    touched = jobs.touched_buckets(seen.filter(F.col("ts") < F.lit(T0 + timedelta(days=1))))
    found = jobs._rows_of(store.read("log_entries"), touched)
    assert found.count() == 2
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    jobs.recompute(store, touched)
    assert store.read("log_rollup").count() == 1
    got = store.read("latency_sketch").select("timed", "min_ms", "max_ms").collect()
    assert [tuple(r) for r in got] == [(1, 4000.0, 4000.0)]
    # A day that has no rows any more goes, the others stay.
    jobs.recompute(store, jobs.touched_buckets(seen))
    tables.drop_days(spark, store.path("log_entries"), [T0.date()])
    jobs.recompute(store, touched)
    assert len(tables.list_days(spark, store.path("log_rollup"))) == 3


def test_touched_buckets_are_distinct_before_their_gap_is_spread(spark):
    logs = rows_of(spark, (0, "s", "INFO", "x", None), (1, "s", "INFO", "y", None))
    starts = logs.withColumn("attrs", F.struct(F.lit("start").alias("phase")))
    touched = jobs.touched_buckets(starts, 3600)
    assert touched.count() == 13
    plan = touched._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("Generate", 1)[1]  # the lower one is printed last


def test_each_rollup_shuffles_its_rows_once(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    lines = [start(10), end(20), (30, "web", "ERROR", "boom 1", None), (400, "web", "ERROR", "boom 2", None)]
    tables.ingest_rows(spark, rows_of(spark, *lines), store.path("log_entries"))
    plans = []
    replace = tables.replace_buckets

    def seen(session, path, table, new, buckets):
        if table in ("log_rollup", "endpoint_rollup"):
            new.collect()
            plans.append(new._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
        replace(session, path, table, new, buckets)

    monkeypatch.setattr(tables, "replace_buckets", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        jobs.run_rollup(store, T0 + timedelta(minutes=8))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 2 and all(re.search(r"ReusedExchange \[[^\]]*_bits", p) for p in plans), plans
    assert [(r["total"], r["timed"]) for r in store.read("log_rollup").orderBy("bucket").collect()] == [(3, 1), (1, 0)]
