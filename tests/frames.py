"""Small tables for tests. Imported by name, so no conftest can stand in its way."""

from __future__ import annotations

from tidelog import schemas


def logs_frame(spark, rows):
    """log_entries rows from short tuples: id, ts, service, severity, body, attrs dict."""
    names = ["duration_ms", "status", "method", "route", "req_id", "phase"]
    data = []
    for number, ts, service, severity, body, attrs in rows:
        packed = tuple(attrs.get(n) for n in names) if attrs else None
        data.append((number, ts, "h1", service, "pm2", severity, body, packed))
    ddl = (
        "id bigint, ts timestamp, host string, service string, kind string, severity string, "
        f"body string, attrs {schemas.ATTRS_DDL}"
    )
    return spark.createDataFrame(data, ddl)
