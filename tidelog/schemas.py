"""Every table of the data model as an explicit schema; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


ATTRS_DDL = (
    "struct<duration_ms: double, status: int, method: string, route: string, "
    "req_id: string, phase: string>"
)

# Table name -> DDL. `day` is the partition column of the day-partitioned tables.
TABLES: dict[str, str] = {
    "log_entries": (
        "id bigint, ts timestamp, host string, service string, kind string, severity string, "
        f"body string, attrs {ATTRS_DDL}, fp string, trace_id string, span_id string, day date"
    ),
    "metrics": (
        "ts timestamp, host string, service string, kind string, cpu double, mem_bytes bigint, "
        "restarts int, status string, day date"
    ),
    "host_metrics": (
        "ts timestamp, host string, cpu double, load1 double, mem_used bigint, "
        "mem_total bigint, disk_used bigint, disk_total bigint, day date"
    ),
    "alert_rules": (
        "id int, name string, kind string, target struct<service: string>, threshold double, "
        "window_secs int, channels array<string>, enabled boolean, silenced_until timestamp"
    ),
    "alert_events": (
        "id bigint, ts timestamp, rule_id int, service string, host string, value double, "
        "state string"
    ),
    "alert_state": (
        "rule_id int, service string, state string, since timestamp, notified_at timestamp"
    ),
    "maintenance_log": "ts timestamp, action string, detail string",
    "log_rollup": (
        "bucket timestamp, host string, service string, errors bigint, warns bigint, "
        "total bigint, p50_ms double, p95_ms double, p99_ms double, max_ms double, "
        "timed bigint, req_errors bigint, apdex_s bigint, apdex_t bigint, day date"
    ),
    "endpoint_rollup": (
        "bucket timestamp, host string, service string, method string, route string, "
        "calls bigint, errors bigint, clienterr bigint, p50_ms double, p95_ms double, "
        "p99_ms double, max_ms double, day date"
    ),
    "latency_sketch": (
        "bucket timestamp, host string, service string, timed bigint, min_ms double, "
        "max_ms double, sketch binary, day date"
    ),
    "error_groups": (
        "fp string, host string, service string, severity string, sample string, "
        "first_seen timestamp, last_seen timestamp, occurrences bigint, state string"
    ),
    "error_group_bucket": "bucket timestamp, fp string, occurrences bigint, day date",
    "db_metrics": (
        "ts timestamp, host string, service string, engine string, metric string, "
        "value double, detail string"
    ),
    "cert_expiry": (
        "domain string, host string, not_after timestamp, days_left int, issuer string, "
        "checked_at timestamp, error string"
    ),
}

# The record a collector sends, before defaults are filled in.
EVENT_DDL = (
    "ts string, host string, service string, kind string, severity string, body string, "
    f"message string, attrs {ATTRS_DDL}"
)

CONTAINER_DDL = "message string, container_name string, timestamp timestamp"
JOURNAL_DDL = "message string, _SYSTEMD_UNIT string, PRIORITY string, timestamp timestamp"

PROCESS_LIST_DDL = (
    "array<struct<name: string, "
    "pm_out_log_path: string, pm_err_log_path: string, pm_log_path: string, "
    "monit: struct<cpu: double, memory: bigint>, "
    "pm2_env: struct<restart_time: int, status: string, pm_out_log_path: string, "
    "pm_err_log_path: string, pm_log_path: string>>>"
)


def schema(table: str) -> T.StructType:
    return _struct(TABLES[table])


# Natural keys of the keyed tables (an upsert replaces rows with an equal key).
KEYS: dict[str, list[str]] = {
    "log_rollup": ["bucket", "host", "service"],
    "endpoint_rollup": ["bucket", "host", "service", "method", "route"],
    "latency_sketch": ["bucket", "host", "service"],
    "error_groups": ["fp"],
    "error_group_bucket": ["bucket", "fp"],
    "alert_state": ["rule_id", "service"],
    "cert_expiry": ["domain"],
}
