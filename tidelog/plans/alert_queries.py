"""Queries for alert conditions, evaluation, transitions and rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import schemas
from tidelog.operators import alerts as A
from tidelog.operators import conditions as C
from tidelog.plans.registry import query
from tidelog.plans.rollup_queries import (
    ERRORS_SQL,
    GROUPS_SQL,
    PAIRS_SQL,
    RESOLVED_SQL,
    SERVICE_SQL,
    ENDPOINT_SQL,
    TRIAGED_SQL,
    endpoint_rollup_table,
    log_rollup,
    triaged_groups,
)
from tidelog.plans.standins import AS_OF, MONTH, WEEK, base, ctes, from_sql, logs, view
from tidelog.session import cut_lineage

_NOW = f"TIMESTAMP '{AS_OF}'"


def _since(seconds: int) -> str:
    return f"{_NOW} - to_seconds({seconds})"


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    made = {
        "log_entries": logs,
        "error_groups": triaged_groups,
        "log_rollup": log_rollup,
        "endpoint_rollup": endpoint_rollup_table,
    }
    return {
        n: made[n](spark, sf_dir) if n in made else view(spark, sf_dir, n) for n in names
    }


def _firing(kind: str, measured: DataFrame, threshold: float) -> DataFrame:
    return measured.filter(C.fires(kind, F.lit(threshold))).select("key", F.round("value", 6).alias("value"))


# Thresholds chosen so that some keys fire and some do not.
LIMITS = {
    "error_rate": 150.0, "crash_loop": 5.0, "service_down": 1.0, "unhealthy": 1.0, "disk": 5.0,
    "cpu": 12.5, "memory": 12.4, "latency_p95": 6000.0, "endpoint_latency": 6000.0,
    "endpoint_errors": 99.0, "traffic_drop": 1.0, "cert_expiry": 14.0,
}

_LATEST = f"""
    SELECT service, host, arg_max(status, (ts, status)) AS status FROM metrics
    WHERE ts > {_since(MONTH)} GROUP BY service, host"""

# kind -> (CTEs needed, SQL of key and value for rows that fire)
_CONDITION_SQL = {
    "error_rate": f"""
        SELECT l.service AS key, CAST(count(*) AS DOUBLE) AS value FROM logs l
        WHERE l.ts > {_since(MONTH)} AND l.severity IN ('ERROR', 'FATAL')
          AND NOT EXISTS (SELECT 1 FROM error_groups g
                          WHERE g.service = l.service AND g.state = 'ignored'
                            AND starts_with(l.body, left(g.sample, 40)))
        GROUP BY 1 HAVING count(*) > {LIMITS["error_rate"]}""",
    "crash_loop": f"""
        SELECT service AS key, CAST(max(n) AS DOUBLE) AS value FROM (
          SELECT service, host, max(restarts) - min(restarts) AS n FROM metrics
          WHERE ts > {_since(MONTH)} AND kind = 'pm2' AND restarts IS NOT NULL GROUP BY 1, 2)
        GROUP BY 1 HAVING max(n) > {LIMITS["crash_loop"]}""",
    "service_down": f"""
        SELECT DISTINCT service AS key, 1.0::DOUBLE AS value FROM ({_LATEST})
        WHERE status NOT IN ('online', 'running', 'healthy')""",
    "unhealthy": f"""
        SELECT DISTINCT service AS key, 1.0::DOUBLE AS value FROM ({_LATEST}) WHERE status = 'unhealthy'""",
    "disk": f"""
        SELECT concat('_host_:', host) AS key, round(v) AS value FROM (
          SELECT host, 100.0::DOUBLE * arg_max(disk_used, (ts, disk_used))
                 / nullif(arg_max(disk_total, (ts, disk_used)), 0) AS v
          FROM host_metrics WHERE ts > {_since(MONTH)} GROUP BY host)
        WHERE v > {LIMITS["disk"]}""",
    "cpu": f"""
        SELECT service AS key, round(avg(cpu), 1) AS value FROM metrics
        WHERE ts > {_since(MONTH)} GROUP BY 1 HAVING avg(cpu) > {LIMITS["cpu"]}""",
    "memory": f"""
        SELECT service AS key, round(max(v)) AS value FROM (
          SELECT m.service, m.host, 100.0::DOUBLE * avg(m.mem_bytes) / nullif(any_value(t.t), 0) AS v
          FROM metrics m JOIN (SELECT host, max(mem_total) AS t FROM host_metrics
                               WHERE ts > {_since(MONTH)} GROUP BY host) t USING (host)
          WHERE m.ts > {_since(MONTH)} GROUP BY 1, 2)
        GROUP BY 1 HAVING max(v) > {LIMITS["memory"]}""",
    "latency_p95": f"""
        SELECT service AS key, round(max(p95_ms)) AS value FROM log_rollup
        WHERE bucket > {_since(MONTH)} GROUP BY 1 HAVING max(p95_ms) > {LIMITS["latency_p95"]}""",
    "endpoint_latency": f"""
        SELECT concat(service, '  ', trim(concat(method, ' ', route))) AS key,
               round(max(p95_ms)) AS value
        FROM endpoint_rollup WHERE bucket > {_since(MONTH)} AND p95_ms IS NOT NULL
        GROUP BY service, method, route
        HAVING sum(calls) >= 5 AND max(p95_ms) > {LIMITS["endpoint_latency"]}""",
    "endpoint_errors": f"""
        SELECT concat(service, '  ', trim(concat(method, ' ', route))) AS key,
               round(100.0::DOUBLE * sum(errors) / nullif(sum(calls), 0)) AS value
        FROM endpoint_rollup WHERE bucket > {_since(MONTH)} GROUP BY service, method, route
        HAVING sum(calls) >= 10
           AND 100.0 * sum(errors) / nullif(sum(calls), 0) > {LIMITS["endpoint_errors"]}""",
    "traffic_drop": f"""
        SELECT c.service AS key, round(100.0::DOUBLE * (b.n - c.n) / nullif(b.n, 0)) AS value
        FROM (SELECT service, sum(timed) AS n FROM log_rollup
              WHERE bucket > {_since(WEEK)} GROUP BY 1) c
        JOIN (SELECT service, sum(timed) AS n FROM log_rollup
              WHERE bucket > {_since(2 * WEEK)} AND bucket <= {_since(WEEK)} GROUP BY 1) b
          USING (service)
        WHERE b.n >= 100 AND 100.0 * (b.n - c.n) / nullif(b.n, 0) > {LIMITS["traffic_drop"]}""",
    "cert_expiry": f"""
        SELECT domain AS key, CAST(days_left AS DOUBLE) AS value FROM cert_expiry
        WHERE days_left <= {LIMITS["cert_expiry"]}""",
}
WINDOWS = {k: WEEK if k == "traffic_drop" else MONTH for k in _CONDITION_SQL}

_ALL_CTES = ctes(
    "logs", "metrics", "host_metrics", "cert_expiry",
    errors=ERRORS_SQL, stats=GROUPS_SQL, error_groups=TRIAGED_SQL,
    pairs=PAIRS_SQL, resolved=RESOLVED_SQL, log_rollup=SERVICE_SQL, endpoint_rollup=ENDPOINT_SQL,
)
_NEEDS = {
    "error_rate": ("log_entries", "error_groups"),
    "crash_loop": ("metrics",),
    "service_down": ("metrics",),
    "unhealthy": ("metrics",),
    "disk": ("host_metrics",),
    "cpu": ("metrics",),
    "memory": ("metrics", "host_metrics"),
    "latency_p95": ("log_rollup",),
    "endpoint_latency": ("endpoint_rollup",),
    "endpoint_errors": ("endpoint_rollup",),
    "traffic_drop": ("log_rollup",),
    "cert_expiry": ("cert_expiry",),
}


def _register_condition(kind: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = tables(spark, sf_dir, *_NEEDS[kind])
        return _firing(kind, C.CONDITIONS[kind](t, WINDOWS[kind], AS_OF), LIMITS[kind])

    run.__name__ = f"alert_{kind}"
    query(_ALL_CTES + _CONDITION_SQL[kind])(run)


for _kind in C.CONDITIONS:
    _register_condition(_kind)


# -- evaluation ----------------------------------------------------------------------------------
# One rule per kind for all services (ids 1..12) and one per kind for svc3 (ids 13..24). The
# threshold of a rule scoped to svc3 is 0, so it fires whenever there is something to see.

_KINDS = list(C.CONDITIONS)


def _rules(spark: SparkSession) -> DataFrame:
    rows = []
    for i, kind in enumerate(_KINDS):
        silenced = "2024-02-01 00:00:00" if i % 4 == 0 else None
        rows.append((i + 1, f"all {kind}", kind, ("*",), LIMITS[kind], WINDOWS[kind], ["mail"], True, silenced))
        rows.append((i + 13, f"svc3 {kind}", kind, ("svc3",), 0.0, WINDOWS[kind], [], i % 3 != 2, None))
    loose = schemas.TABLES["alert_rules"].replace("silenced_until timestamp", "silenced_until string")
    frame = spark.createDataFrame(rows, loose)
    return frame.withColumn("silenced_until", F.col("silenced_until").cast("timestamp"))


def _all_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All tables; the rollups, which two kinds each read, are computed once, as a store has them."""
    found = tables(spark, sf_dir, *sorted({n for needs in _NEEDS.values() for n in needs}))
    return found | {n: cut_lineage(found[n]) for n in ("log_rollup", "endpoint_rollup")}


def _firing_sql() -> str:
    parts = []
    for i, kind in enumerate(_KINDS):
        sql = _CONDITION_SQL[kind]
        parts.append(f"SELECT {i + 1} AS rule_id, '{kind}' AS kind, key, value FROM ({sql})")
        if i % 3 == 2:
            continue  # a disabled rule
        limit = f"> {LIMITS[kind]}"
        loose = sql.replace(limit, "> 0.0").replace(f"<= {LIMITS[kind]}", "<= 0.0")
        scope = "" if kind in A.HOST_KINDS else " WHERE key = 'svc3' OR starts_with(key, 'svc3  ')"
        parts.append(f"SELECT {i + 13} AS rule_id, '{kind}' AS kind, key, value FROM ({loose}){scope}")
    return " UNION ALL ".join(parts)


@query(_ALL_CTES + _firing_sql())
def alert_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.evaluate(_rules(spark), _all_tables(spark, sf_dir), AS_OF).firing


# State before this run, from the data: services with a low error count were firing, each
# with any of the rules; the others had recovered.
_STATE_SQL = f"""
    SELECT CAST(1 + user_id % 24 AS INT) AS rule_id,
           concat('svc', CAST(user_id % 8 AS STRING)) AS service,
           CASE WHEN count(*) % 2 = 0 THEN 'firing' ELSE 'resolved' END AS state,
           max(CAST(ts AS TIMESTAMP)) AS since, min(CAST(ts AS TIMESTAMP)) AS notified_at
    FROM events GROUP BY 1, 2"""


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, _STATE_SQL, "events")


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rules = _rules(spark)
    done = A.evaluate(rules, _all_tables(spark, sf_dir), AS_OF)
    return A.transitions(_state(spark, sf_dir), done.firing, rules, AS_OF, done.evaluated, "hub")


_MARKED = f"""
    SELECT coalesce(s.rule_id, f.rule_id) AS rule_id, coalesce(s.service, f.key) AS service,
           s.state AS was, s.since, s.notified_at, f.value, r.name, r.kind, r.silenced,
           CASE WHEN NOT coalesce(r.enabled, false) THEN NULL
                WHEN f.key IS NOT NULL AND coalesce(s.state, '') <> 'firing' THEN 'firing'
                WHEN f.key IS NULL AND s.state = 'firing' THEN 'resolved' END AS change
    FROM state s FULL JOIN firing f ON s.rule_id = f.rule_id AND s.service = f.key
    LEFT JOIN rules r ON r.rule_id = coalesce(s.rule_id, f.rule_id)"""
_RULES_SQL = " UNION ALL ".join(
    f"SELECT {i + 1} AS rule_id, 'all {k}' AS name, '{k}' AS kind, {str(i % 4 == 0).lower()} AS silenced, true AS enabled"
    f" UNION ALL SELECT {i + 13}, 'svc3 {k}', '{k}', false, {str(i % 3 != 2).lower()}"
    for i, k in enumerate(_KINDS)
)
_TRANSITION_CTES = ctes(
    "logs", "metrics", "host_metrics", "cert_expiry",
    errors=ERRORS_SQL, stats=GROUPS_SQL, error_groups=TRIAGED_SQL,
    pairs=PAIRS_SQL, resolved=RESOLVED_SQL, log_rollup=SERVICE_SQL, endpoint_rollup=ENDPOINT_SQL,
    state=_STATE_SQL, firing=_firing_sql(), rules=_RULES_SQL, marked=_MARKED,
)
_WHOLE = "CAST(CAST(value AS BIGINT) AS VARCHAR)"
_TEXT = f"""CASE kind
    WHEN 'error_rate' THEN concat(service, ': ', {_WHOLE}, ' errors in the last 30d')
    WHEN 'crash_loop' THEN concat(service, ': restarted ', {_WHOLE}, ' times in the last 30d')
    WHEN 'service_down' THEN concat(service, ': not running')
    WHEN 'unhealthy' THEN concat(service, ': health check failing')
    WHEN 'disk' THEN concat('disk ', {_WHOLE}, '% full')
    WHEN 'cpu' THEN concat(service, ': CPU ', CAST(CAST(value AS DECIMAL(20, 1)) AS VARCHAR), '% sustained')
    WHEN 'memory' THEN concat(service, ': memory ', {_WHOLE}, '% of host')
    WHEN 'endpoint_errors' THEN concat(service, ': ', {_WHOLE}, '% of calls failing')
    WHEN 'traffic_drop' THEN concat(service, ': requests ', {_WHOLE}, '% below the same 7d last week')
    WHEN 'cert_expiry' THEN concat(service, ': TLS certificate expires in ', {_WHOLE}, ' days')
    ELSE concat(service, ': p95 latency ', {_WHOLE}, ' ms') END"""


@query(
    _TRANSITION_CTES
    + f"""SELECT {_NOW} AS ts, rule_id, service, 'hub' AS host,
                 CASE WHEN change = 'firing' THEN value END AS value, change AS state,
                 name, kind, NOT silenced AS notify,
                 CASE WHEN change = 'firing' THEN concat('🔴 ', {_TEXT})
                      ELSE concat('✅ ', service, ': ', name, ' recovered') END AS message
          FROM marked WHERE change IS NOT NULL"""
)
def alert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)[1].drop("channels")


@query(
    _TRANSITION_CTES
    + f"""SELECT rule_id, service, coalesce(change, was) AS state,
                 CASE WHEN change IS NULL THEN since ELSE {_NOW} END AS since,
                 CASE WHEN change = 'firing' THEN {_NOW} ELSE notified_at END AS notified_at
          FROM marked"""
)
def alert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)[0]


@query(
    _TRANSITION_CTES
    + """SELECT r.rule_id AS id, r.kind, count(*) FILTER (coalesce(m.change, m.was) = 'firing') AS firing
         FROM rules r LEFT JOIN marked m USING (rule_id) GROUP BY 1, 2"""
)
def rule_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = A.list_rules(_rules(spark), _run(spark, sf_dir)[0])
    return listed.select("id", "kind", "firing")


@query(
    _TRANSITION_CTES
    + f"""SELECT {_NOW} AS ts, service, 'hub' AS host, CASE WHEN change = 'firing' THEN value END AS value,
                 change AS state, name, kind
          FROM marked WHERE change IS NOT NULL ORDER BY ts DESC, rule_id, service LIMIT 100"""
)
def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.event_history(_run(spark, sf_dir)[1], _rules(spark))


@query(
    _TRANSITION_CTES
    + f"""SELECT service, CASE WHEN change IS NULL THEN since ELSE {_NOW} END AS since,
                 name, kind
          FROM marked WHERE kind IS NOT NULL AND coalesce(change, was) = 'firing'"""
)
def firing_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.firing_now(_run(spark, sf_dir)[0], _rules(spark))


_ON = _KINDS + [k for i, k in enumerate(_KINDS) if i % 3 != 2]


def _list(kinds: list[str]) -> str:
    return "[" + ", ".join(f"'{k}'" for k in sorted(kinds)) + "]"


@query(
    ctes("metrics", "selected")
    + f"""SELECT service, true AS metrics, logs,
                 array_to_string(CASE WHEN logs THEN {_list(_ON)}
                      ELSE {_list([k for k in _ON if k not in A.LOG_KINDS])} END, ',') AS rules,
                 array_to_string(CASE WHEN logs THEN []
                      ELSE {_list([k for k in _ON if k in A.LOG_KINDS])} END, ',') AS unavailable
          FROM (SELECT DISTINCT service, service IN (SELECT service FROM selected) AS logs
                FROM metrics WHERE ts > TIMESTAMP '2024-01-15 00:00:00' - INTERVAL '1 hour')"""
)
def alert_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = A.coverage(
        view(spark, sf_dir, "metrics"), _rules(spark), view(spark, sf_dir, "selected"), "2024-01-15 00:00:00"
    )
    return seen.withColumns(
        {c: F.array_join(c, ",") for c in ("rules", "unavailable")}
    )


# -- rule changes: one rule per supplier, changed from the same table ------------------------------


def _kind_of(column: str) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col(column) % 12 + 1).cast("int"))


def _supplier_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("int").alias("id"),
        F.col("s_name").alias("name"),
        _kind_of("s_suppkey").alias("kind"),
        F.struct(F.lit("*").alias("service")).alias("target"),
        F.col("s_acctbal").alias("threshold"),
        F.lit(300).alias("window_secs"),
        F.array().cast("array<string>").alias("channels"),
        F.lit(True).alias("enabled"),
        F.lit(None).cast("timestamp").alias("silenced_until"),
    )


def _supplier_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = base(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    op = F.when(key % 5 == 0, "delete").when(key % 5 == 1, "patch").when(key % 5 == 2, "create")
    none = F.lit(None)
    return s.withColumn("op", op).filter(F.col("op").isNotNull()).select(
        "op",
        key.cast("int").alias("seq"),
        key.cast("int").alias("id"),
        F.array(F.lit("threshold"), F.lit("enabled")).alias("fields"),
        F.concat(F.lit("  new "), "s_name").alias("name"),
        _kind_of("s_suppkey").alias("kind"),
        F.when(key % 2 == 0, F.lit(" ")).otherwise(F.lit("api")).alias("service"),
        F.when(key % 3 == 0, none).otherwise(F.col("s_acctbal") + 1).cast("double").alias("threshold"),
        F.when(key % 2 == 0, F.lit(0)).otherwise(F.lit(600)).alias("window_secs"),
        none.cast("array<string>").alias("channels"),
        (key % 2 == 0).alias("enabled"),
        none.cast("timestamp").alias("silenced_until"),
    )


_KIND_SQL = "([" + ", ".join(f"'{k}'" for k in _KINDS) + "])[CAST(s_suppkey % 12 + 1 AS INT)]"
_NEW_T = "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal + 1 END"


@query(
    f"""SELECT CAST(s_suppkey AS INT) AS id, s_name AS name, {_KIND_SQL} AS kind, '*' AS service,
               CASE WHEN s_suppkey % 5 = 1 THEN {_NEW_T} ELSE s_acctbal END AS threshold,
               300 AS window_secs, NOT (s_suppkey % 5 = 1 AND s_suppkey % 2 = 1) AS enabled
        FROM supplier WHERE s_suppkey % 5 <> 0
        UNION ALL
        SELECT CAST((SELECT max(s_suppkey) FROM supplier) + s_suppkey AS INT), concat('new ', s_name),
               {_KIND_SQL}, CASE WHEN s_suppkey % 2 = 0 THEN '*' ELSE 'api' END, {_NEW_T},
               CASE WHEN s_suppkey % 2 = 0 THEN 300 ELSE 600 END, s_suppkey % 2 = 0
        FROM supplier WHERE s_suppkey % 5 = 2"""
)
def rule_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _supplier_rules(spark, sf_dir)
    state = spark.createDataFrame([], schemas.schema("alert_state"))
    changed, _ = A.apply_rule_changes(rules, state, _supplier_changes(spark, sf_dir))
    return changed.select(
        "id", "name", "kind", "target.service", "threshold", "window_secs", "enabled"
    )
