from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from frames import logs_frame
from pyspark.sql import functions as F

from tidelog import schemas
from tidelog.operators import alerts, conditions, errors

NOW = datetime(2026, 1, 10, 12)
AS_OF = NOW.isoformat()


def error_logs(spark, *rows):
    return logs_frame(spark, [(i, NOW - timedelta(seconds=s), svc, sev, body, None) for i, (s, svc, sev, body) in enumerate(rows)])


# -- error groups --------------------------------------------------------------------------------


def test_fingerprint_ignores_variable_parts(spark):
    rows = [
        (1, "a", "ERROR", 'user 17 "x" deadbeefdeadbeef 550e8400-e29b-41d4-a716-446655440000\n at 1'),
        (2, "a", "FATAL", 'user 18 "yy" 0123456789abcdef 550e8400-e29b-41d4-a716-446655440001\n at 2'),
        (3, "b", "ERROR", "user 17"),
        (4, "a", "INFO", "user 17"),
    ]
    stats = errors.group_stats(errors.error_rows(error_logs(spark, *rows))).collect()
    by_service = {r["service"]: r for r in stats}
    assert len(stats) == 2 and by_service["a"]["occurrences"] == 2
    assert by_service["a"]["sample"].startswith("user 17") and "\n" not in by_service["a"]["sample"]
    assert by_service["a"]["severity"] == "ERROR"


def test_merge_reopens_and_is_harmless_when_repeated(spark):
    new = errors.group_stats(errors.error_rows(error_logs(spark, (1, "a", "ERROR", "boom"), (2, "b", "ERROR", "boom"))))
    old = new.withColumn("state", F.when(F.col("service") == "a", "resolved").otherwise("ignored"))
    quiet = old.limit(0).drop("state")
    same = errors.merge_error_groups(old, quiet).collect()
    assert {r["service"]: r["state"] for r in same} == {"a": "resolved", "b": "ignored"}
    once = errors.merge_error_groups(old, new)
    assert {r["service"]: (r["state"], r["occurrences"]) for r in once.collect()} == {"a": ("open", 2), "b": ("ignored", 2)}
    replaced = errors.merge_error_groups(old, new, add_counts=False)
    twice = errors.merge_error_groups(replaced, new, add_counts=False)
    assert sorted(map(tuple, replaced.collect())) == sorted(map(tuple, twice.collect()))


def test_triage_allows_three_states(spark):
    groups = errors.group_stats(errors.error_rows(error_logs(spark, (1, "a", "ERROR", "x")))).withColumn("state", F.lit("open"))
    change = groups.select("fp", F.lit("ignored").alias("state"))
    assert errors.set_group_state(groups, change).first()["state"] == "ignored"
    assert errors.list_groups(errors.set_group_state(groups, change)).count() == 0
    assert errors.list_groups(errors.set_group_state(groups, change), include_ignored=True).count() == 1
    with pytest.raises(Exception, match="state must be"):
        errors.set_group_state(groups, groups.select("fp", F.lit("closed").alias("state"))).collect()


def test_ignored_groups_do_not_count(spark):
    logs = error_logs(
        spark, (1, "a", "ERROR", "50% of _x failed: " + "y" * 60), (2, "a", "ERROR", "other"),
        (3, "a", "ERROR", "short and more"), (4, "b", "ERROR", "short and more"), (9999, "a", "ERROR", "old"),
        (5, "a", "ERROR", "50X of zx failed: " + "y" * 60),
    )
    groups = spark.createDataFrame(
        [("a", "50% of _x failed: " + "y" * 60, "ignored"), ("a", "short", "ignored"), ("b", "other", "open")],
        "service string, sample string, state string",
    )
    got = conditions.error_rate({"log_entries": logs, "error_groups": groups}, 300, AS_OF)
    assert {r["key"]: r["value"] for r in got.collect()} == {"a": 2.0, "b": 1.0}


# -- scope, evaluation, transitions ------------------------------------------------------------------

SERVICES = {"api": "12", "worker": "9"}
ENDPOINTS = {"api  GET /leads/:id": "9400", "api  POST /login": "620", "worker  GET /health": "3100"}
SCOPE_CASES = [
    ("cpu", "*", SERVICES, SERVICES),
    ("cpu", "worker", SERVICES, {"worker": "9"}),
    ("endpoint_latency", "api", ENDPOINTS, {k: v for k, v in ENDPOINTS.items() if k.startswith("api")}),
    ("endpoint_latency", "ap", ENDPOINTS, {}),
    ("disk", "worker", {"_host_": "91"}, {"_host_": "91"}),
    ("cert_expiry", "worker", {"api.example.com": "7"}, {"api.example.com": "7"}),
    ("cpu", "absent", SERVICES, {}),
]


@pytest.mark.parametrize(("kind", "scope", "firing", "want"), SCOPE_CASES)
def test_scope(spark, kind, scope, firing, want):
    frame = spark.createDataFrame(list(firing.items()), "key string, value string")
    kept = frame.filter(alerts.in_scope(F.lit(kind), F.lit(scope), F.col("key")))
    assert {r["key"]: r["value"] for r in kept.collect()} == want


def test_every_kind_has_a_message():
    assert set(alerts.MESSAGES) == set(conditions.CONDITIONS)
    assert set(alerts.LOG_KINDS) | set(alerts.HOST_KINDS) <= set(conditions.CONDITIONS)


def rules_frame(spark, *rows):
    """(id, kind, threshold, window, scope, enabled, silenced_until)"""
    data = [(i, f"rule {i}", k, (s,), t, w, [], e, u) for i, k, t, w, s, e, u in rows]
    return spark.createDataFrame(data, schemas.schema("alert_rules"))


def metrics_frame(spark, *rows):
    data = [(NOW - timedelta(seconds=s), "h1", svc, "pm2", cpu, 100, 1, status, NOW.date()) for s, svc, cpu, status in rows]
    return spark.createDataFrame(data, schemas.schema("metrics"))


def test_one_broken_rule_leaves_the_others_and_its_state_alone(spark):
    rules = rules_frame(
        spark, (1, "cpu", 50.0, 900, "*", True, None), (2, "latency_p95", 1.0, 900, "*", True, None),
        (3, "cpu", 50.0, 900, "b", False, None), (4, "no_such_kind", 0.0, 60, "*", True, None),
    )
    tables = {"metrics": metrics_frame(spark, (1, "a", 95.0, "online"), (2, "b", 10.0, "online"))}
    done = alerts.evaluate(rules, tables, AS_OF)  # no log_rollup table
    assert done.evaluated == [1] and list(done.failures) == [2]
    state = spark.createDataFrame([(2, "x", "firing", NOW, NOW), (3, "y", "firing", NOW, NOW)], schemas.schema("alert_state"))
    new, events = alerts.transitions(state, done.firing, rules, AS_OF, done.evaluated)
    assert {(r["rule_id"], r["service"], r["state"]) for r in new.collect()} == {
        (1, "a", "firing"), (2, "x", "firing"), (3, "y", "firing"),
    }
    assert [(r["rule_id"], r["message"]) for r in events.collect()] == [(1, "🔴 a: CPU 95.0% sustained")]


def test_transitions_speak_once(spark):
    rules = rules_frame(
        spark, (1, "error_rate", 5.0, 7200, "*", True, None), (2, "cpu", 5.0, 300, "*", True, NOW + timedelta(hours=1)),
        (3, "cert_expiry", 14.0, 86400, "*", True, NOW - timedelta(hours=1)),
    )
    state = spark.createDataFrame([], schemas.schema("alert_state"))
    firing = spark.createDataFrame([(1, "error_rate", "a", 12.0), (2, "cpu", "a", 91.25), (3, "cert_expiry", "d.org", 3.0)], alerts.FIRING_DDL)
    later = (NOW + timedelta(minutes=1)).isoformat()
    state, events = alerts.transitions(state, firing, rules, AS_OF)
    texts = {r["rule_id"]: (r["message"], r["notify"], r["value"]) for r in events.collect()}
    assert texts == {
        1: ("🔴 a: 12 errors in the last 2h", True, 12.0),
        2: ("🔴 a: CPU 91.3% sustained", False, 91.25),
        3: ("🔴 d.org: TLS certificate expires in 3 days", True, 3.0),
    }
    steady, none = alerts.transitions(state, firing, rules, later)
    assert none.count() == 0
    assert sorted(map(tuple, steady.collect())) == sorted(map(tuple, state.collect()))
    over, events = alerts.transitions(steady, firing.limit(0), rules, later)
    assert {r["message"] for r in events.collect()} == {"✅ a: rule 1 recovered", "✅ a: rule 2 recovered", "✅ d.org: rule 3 recovered"}
    assert all(r["value"] is None and r["state"] == "resolved" for r in events.collect())
    assert {r["state"] for r in over.collect()} == {"resolved"} and all(r["notified_at"] == NOW for r in over.collect())
    _, none = alerts.transitions(over, firing.limit(0), rules, later)
    assert none.count() == 0
    assert alerts.firing_now(state, rules).count() == 3 and alerts.firing_now(over, rules).count() == 0
    assert [r["firing"] for r in alerts.list_rules(rules, state).collect()] == [1, 1, 1]


def test_latest_status_decides(spark):
    rows = metrics_frame(
        spark, (100, "a", 0.0, "online"), (10, "a", 0.0, "stopped"), (100, "b", 0.0, "stopped"), (10, "b", 0.0, "running"),
        (10, "c", 0.0, "unhealthy"), (10, "d", 0.0, None), (170, "e", 0.0, "errored"), (250, "f", 0.0, "unhealthy"),
    )
    t = {"metrics": rows}
    down = {r["key"] for r in conditions.service_down(t, 60, AS_OF).collect()}
    assert down == {"a", "c", "e"}  # at least three minutes are looked at
    assert {r["key"] for r in conditions.unhealthy(t, 60, AS_OF).collect()} == {"c", "f"}


def test_hosts_are_judged_apart(spark):
    ddl = "ts timestamp, host string, service string, kind string, restarts int, status string"
    at = [NOW - timedelta(seconds=k) for k in (20, 10)]
    rows = [(t, h, "api", "pm2", n, s) for h, n, s in (("A", 500, "unhealthy"), ("B", 2, "online")) for t in at]
    rows += [(NOW - timedelta(seconds=1), "B", "api", "pm2", 5, "online")]
    t = {"metrics": spark.createDataFrame(rows, ddl)}
    assert [tuple(r) for r in conditions.crash_loop(t, 300, AS_OF).collect()] == [("api", 3.0, 3.0)]
    for condition in (conditions.service_down, conditions.unhealthy):
        assert [r["key"] for r in condition(t, 300, AS_OF).collect()] == ["api"]


def test_disk_key_names_the_host(spark):
    ddl = "ts timestamp, host string, disk_used bigint, disk_total bigint"
    one = spark.createDataFrame([(NOW, "h1", 91, 100), (NOW - timedelta(seconds=9), "h1", 10, 100)], ddl)
    two = one.unionByName(spark.createDataFrame([(NOW, "h2", 5, 0)], ddl))
    got = conditions.disk({"host_metrics": one}, 300, AS_OF).collect()
    assert [(r["key"], r["value"]) for r in got] == [("_host_:h1", 91.0)]
    got = conditions.disk({"host_metrics": two}, 300, AS_OF).collect()
    assert {r["key"]: r["value"] for r in got} == {"_host_:h1": 91.0, "_host_:h2": None}


def test_traffic_drop_needs_a_baseline_and_silence_is_optional(spark):
    week = timedelta(days=7)
    rows = [
        (NOW - timedelta(minutes=5), "a", 40), (NOW - week - timedelta(minutes=5), "a", 100),
        (NOW - timedelta(minutes=5), "b", 1), (NOW - week - timedelta(minutes=5), "b", 99),
        (NOW - week, "c", 100), (NOW - week - timedelta(minutes=15), "a", 1000),
    ]
    t = {"log_rollup": spark.createDataFrame(rows, "bucket timestamp, service string, timed bigint")}
    assert {r["key"]: r["value"] for r in conditions.traffic_drop(t, 900, AS_OF).collect()} == {"a": 60.0}
    loud = conditions.traffic_drop(t, 900, AS_OF, include_silent=True)
    assert {r["key"]: r["value"] for r in loud.collect()} == {"a": 60.0, "c": 100.0}


# -- rules -------------------------------------------------------------------------------------------


def test_default_rules(spark):
    empty = spark.createDataFrame([], schemas.schema("alert_rules"))
    seeded = alerts.seed_default_rules(empty)
    assert sorted(r["id"] for r in seeded.collect()) == list(range(1, 10))
    assert sorted(map(tuple, alerts.seed_default_rules(seeded).select("id", "kind").collect())) == sorted(map(tuple, seeded.select("id", "kind").collect()))
    mine = rules_frame(spark, (4, "cpu", 1.0, 60, "*", True, None))
    assert sorted((r["id"], r["kind"]) for r in alerts.seed_default_rules(mine).collect()) == [
        (4, "cpu"), (5, "cert_expiry"), (6, "latency_p95"), (7, "memory"),
    ]


def changes_frame(spark, *rows):
    names = [f.name for f in spark.createDataFrame([], alerts.RULE_CHANGE_DDL).schema.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], alerts.RULE_CHANGE_DDL)


def test_rule_changes(spark):
    rules = rules_frame(spark, (1, "cpu", 1.0, 60, "*", True, None), (2, "disk", 2.0, 60, "*", True, NOW))
    state = spark.createDataFrame([(1, "a", "firing", NOW, NOW), (2, "_host_", "firing", NOW, NOW)], schemas.schema("alert_state"))
    changes = changes_frame(
        spark,
        dict(op="patch", id=2, fields=["silenced_until", "threshold", "name"], name="renamed", threshold=9.0),
        dict(op="delete", id=1),
        dict(op="create", seq=1, name=" New ", kind="memory", service=""),
    )
    new, kept = alerts.apply_rule_changes(rules, state, changes)
    rows = {r["id"]: r for r in new.collect()}
    assert set(rows) == {2, 3}
    assert (rows[2]["threshold"], rows[2]["silenced_until"], rows[2]["name"]) == (9.0, None, "rule 2")
    made = rows[3]
    assert (made["name"], made["target"]["service"], made["window_secs"], made["enabled"]) == ("New", "*", 300, True)
    assert [r["rule_id"] for r in kept.collect()] == [2]
    for bad in (dict(op="create", seq=1, name="x", kind="nope"), dict(op="create", seq=1, name=" ", kind="cpu")):
        with pytest.raises(Exception, match="no evaluator|name is required"):
            alerts.apply_rule_changes(rules, state, changes_frame(spark, bad))[0].collect()
    quiet = alerts.silence(rules, 1, NOW + timedelta(hours=1))
    assert {r["id"]: r["silenced_until"] for r in quiet.collect()}[1] == NOW + timedelta(hours=1)
    assert alerts.kinds(spark).count() == 12


def test_coverage(spark):
    rules = rules_frame(spark, (1, "cpu", 1.0, 60, "*", True, None), (2, "error_rate", 1.0, 60, "*", True, None), (3, "disk", 1.0, 60, "*", False, None))
    metrics = metrics_frame(spark, (10, "a", 1.0, "online"), (10, "b", 1.0, "online"), (4000, "gone", 1.0, "online"))
    selected = spark.createDataFrame([("a",)], "service string")
    rows = {r["service"]: r for r in alerts.coverage(metrics, rules, selected, AS_OF).collect()}
    assert set(rows) == {"a", "b"}
    assert (rows["a"]["rules"], rows["a"]["unavailable"]) == (["cpu", "error_rate"], [])
    assert (rows["b"]["rules"], rows["b"]["unavailable"], rows["b"]["logs"]) == (["cpu"], ["error_rate"], False)


def test_history_keeps_events_of_removed_rules(spark):
    rules = rules_frame(spark, (1, "cpu", 1.0, 60, "*", True, None))
    events = spark.createDataFrame(
        [(i, NOW + timedelta(seconds=i), 1 + i % 2, "s", "h", 1.0, "firing") for i in range(6)], schemas.schema("alert_events")
    )
    rows = alerts.event_history(events, rules, limit=4).collect()
    assert [r["ts"].second for r in rows] == [5, 4, 3, 2] and {r["name"] for r in rows} == {"rule 1", None}
