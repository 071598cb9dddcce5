"""Queries for request pairing, rollups and error groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.timing import bucket, recent
from tidelog.operators import errors as E
from tidelog.operators import pairing, rollup
from tidelog.plans.registry import query
from tidelog.plans.standins import AS_OF, PAIR_GAP, WEEK, ctes, logs
from tidelog.sources import tables

# -- SQL building blocks ------------------------------------------------------------------------

PAIRS_SQL = f"""
    SELECT e.service, e.req_id, e.ts, (epoch_us(e.ts) - epoch_us(s.ts)) / 1000.0 AS gap_ms,
           s.route, s.method
    FROM (SELECT DISTINCT service, req_id, ts FROM logs
          WHERE phase = 'end' AND req_id IS NOT NULL) e
    ASOF JOIN (SELECT service, req_id, ts, arg_max(route, id) AS route,
                      arg_max(method, id) AS method
               FROM logs WHERE phase = 'start' GROUP BY ALL) s
      ON e.service = s.service AND e.req_id = s.req_id AND e.ts >= s.ts
    WHERE epoch_us(e.ts) - epoch_us(s.ts) < {PAIR_GAP * 1_000_000}"""

RESOLVED_SQL = """
    SELECT l.id, l.ts, l.host, l.service, l.severity, coalesce(l.duration_ms, p.gap_ms) AS dur,
           coalesce(l.route, p.route) AS route, coalesce(l.method, p.method) AS method,
           l.status, l.phase
    FROM logs l LEFT JOIN pairs p
      ON l.phase = 'end' AND l.service = p.service AND l.req_id = p.req_id AND l.ts = p.ts"""

SERVICE_SQL = """
    SELECT time_bucket(INTERVAL '5 minutes', ts) AS bucket, host, service,
           count(*) FILTER (severity IN ('ERROR', 'FATAL')) AS errors,
           count(*) FILTER (severity = 'WARN') AS warns, count(*) AS total,
           quantile_cont(dur, 0.50) AS p50_ms, quantile_cont(dur, 0.95) AS p95_ms,
           quantile_cont(dur, 0.99) AS p99_ms, max(dur) AS max_ms, count(dur) AS timed,
           count(*) FILTER (dur IS NOT NULL AND
                            (coalesce(status >= 500, false)
                             OR severity IN ('ERROR', 'FATAL'))) AS req_errors,
           count(*) FILTER (dur <= 500) AS apdex_s,
           count(*) FILTER (dur > 500 AND dur <= 2000) AS apdex_t
    FROM resolved GROUP BY 1, 2, 3"""

ENDPOINT_SQL = """
    SELECT time_bucket(INTERVAL '5 minutes', ts) AS bucket, host, service,
           coalesce(method, '') AS method, route, count(*) AS calls,
           count(*) FILTER (coalesce(status >= 500, false)
                            OR severity IN ('ERROR', 'FATAL')) AS errors,
           count(*) FILTER (status BETWEEN 400 AND 499) AS clienterr,
           quantile_cont(dur, 0.50) AS p50_ms, quantile_cont(dur, 0.95) AS p95_ms,
           quantile_cont(dur, 0.99) AS p99_ms, max(dur) AS max_ms
    FROM resolved WHERE route IS NOT NULL AND coalesce(phase, 'end') = 'end'
    GROUP BY 1, 2, 3, 4, 5"""

ROLLUPS = ctes(
    "logs",
    pairs=PAIRS_SQL,
    resolved=RESOLVED_SQL,
    log_rollup=SERVICE_SQL,
    endpoint_rollup=ENDPOINT_SQL,
)

ERRORS_SQL = r"""
    SELECT md5(concat(service, '|', regexp_replace(regexp_replace(regexp_replace(regexp_replace(
               split_part(body, chr(10), 1),
               '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}',
               '<uuid>', 'g'),
               '\b[0-9a-fA-F]{12,}\b', '<hex>', 'g'),
               '"[^"]*"', '<str>', 'g'),
               '\b\d+\b', '<n>', 'g'))) AS fp,
           id, ts, host, service, severity, split_part(body, chr(10), 1) AS sample
    FROM logs WHERE severity IN ('ERROR', 'FATAL')"""

GROUPS_SQL = """
    SELECT fp, min(host) AS host, min(service) AS service, min(severity) AS severity,
           arg_max(left(sample, 500), (ts, id)) AS sample, min(ts) AS first_seen,
           max(ts) AS last_seen, count(*) AS occurrences
    FROM errors GROUP BY fp"""

# Triage of the stand-in: the first hex digit of the fingerprint decides.
STATE_SQL = (
    "CASE WHEN fp < '4' THEN 'ignored' WHEN fp < '8' THEN 'resolved' ELSE 'open' END"
)
TRIAGED_SQL = f"SELECT *, {STATE_SQL} AS state FROM stats"


def rounded(sql: str, *columns: str) -> str:
    """Outer SELECT that rounds floating-point columns the way the Spark side does."""
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns) + sql


def round_columns(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.resolve_requests(logs(spark, sf_dir), PAIR_GAP)


def log_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.service_rollup(resolved(spark, sf_dir))


def endpoint_rollup_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.endpoint_rollup(resolved(spark, sf_dir))


def triaged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = E.group_stats(E.error_rows(logs(spark, sf_dir)))
    return stats.withColumn("state", F.expr(STATE_SQL))


# -- pairing ---------------------------------------------------------------------------------------


@query(ctes("logs", pairs=PAIRS_SQL) + "SELECT * FROM pairs")
def request_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.pair_requests(logs(spark, sf_dir), PAIR_GAP)


@query(
    ctes("logs", pairs=PAIRS_SQL, resolved=RESOLVED_SQL)
    + "SELECT ts, host, service, severity, dur, route, method, status, phase FROM resolved"
)
def resolved_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir)


# -- rollups ------------------------------------------------------------------------------------------

_P = ["p50_ms", "p95_ms", "p99_ms"]


def _select_rounded(table: str, others: str) -> str:
    return f"SELECT {others}, {rounded('', *_P)} FROM {table}"


@query(
    ROLLUPS
    + _select_rounded(
        "log_rollup",
        "bucket, host, service, errors, warns, total, max_ms, timed, req_errors, apdex_s, apdex_t",
    )
)
def service_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(log_rollup(spark, sf_dir), *_P)


@query(
    ROLLUPS
    + _select_rounded(
        "endpoint_rollup", "bucket, host, service, method, route, calls, errors, clienterr, max_ms"
    )
)
def endpoint_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_columns(endpoint_rollup_table(spark, sf_dir), *_P)


# Two tables from one derivation cannot disagree: requests of both, per service.
@query(
    ROLLUPS
    + """
    SELECT service, CAST(sum(timed) AS BIGINT) AS timed, CAST(sum(calls) AS BIGINT) AS calls FROM (
      SELECT service, timed, 0 AS calls FROM log_rollup
      UNION ALL SELECT service, 0, calls FROM endpoint_rollup) GROUP BY service"""
)
def rollup_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = resolved(spark, sf_dir)
    zero = F.lit(0).cast("bigint")
    by_service = rollup.service_rollup(lines).select("service", "timed", zero.alias("calls"))
    by_route = rollup.endpoint_rollup(lines).select("service", zero.alias("timed"), "calls")
    both = by_service.unionByName(by_route).groupBy("service")
    return both.agg(F.sum("timed").alias("timed"), F.sum("calls").alias("calls"))


@query(
    ROLLUPS
    + """
    SELECT bucket, host, service, errors, warns, total, timed, req_errors, apdex_s, apdex_t, max_ms,
           round(timed / 3600.0, 6) AS req_per_sec,
           round(req_errors / nullif(timed, 0), 6) AS error_rate,
           round((apdex_s + apdex_t / 2.0) / nullif(timed, 0), 6) AS apdex
    FROM (SELECT time_bucket(INTERVAL '1 hour', bucket) AS bucket, host, service,
                 CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(warns) AS BIGINT) AS warns, CAST(sum(total) AS BIGINT) AS total,
                 CAST(sum(timed) AS BIGINT) AS timed, CAST(sum(req_errors) AS BIGINT) AS req_errors, CAST(sum(apdex_s) AS BIGINT) AS apdex_s,
                 CAST(sum(apdex_t) AS BIGINT) AS apdex_t, max(max_ms) AS max_ms
          FROM log_rollup GROUP BY 1, 2, 3)"""
)
def hourly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    combined = rollup.combine_rollups(log_rollup(spark, sf_dir), 3600)
    return round_columns(combined, "req_per_sec", "error_rate", "apdex")


# Percentiles of a month and of a day from merged five-minute sketches: each answer is a value that
# occurred, and its rank in the exact data is compared with the wanted one. Three times the
# usual error is allowed here, so that chance alone does not change the rows.
@query(
    ctes("logs", pairs=PAIRS_SQL, resolved=RESOLVED_SQL)
    + """
    SELECT span, service, bucket, count(*) AS timed, min(dur) AS min_ms, max(dur) AS max_ms,
           true AS p50_ms, true AS p95_ms, true AS p99_ms
    FROM (SELECT 'day' AS span, service, time_bucket(INTERVAL '1 day', ts) AS bucket, dur FROM resolved
          UNION ALL SELECT 'days', service, to_timestamp(floor(epoch(ts) / 2592000) * 2592000) AT TIME ZONE 'UTC', dur
          FROM resolved)
    WHERE dur IS NOT NULL GROUP BY 1, 2, 3"""
)
def sketched_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = resolved(spark, sf_dir).filter(F.col("dur").isNotNull())
    kept = rollup.latency_sketches(timed)
    parts = []
    for span, seconds in (("day", 86400), ("days", 30 * 86400)):
        answers = rollup.sketch_quantiles(rollup.merge_sketches(kept, seconds, ("service",)))
        values = timed.select("service", bucket(F.col("ts"), seconds).alias("bucket"), "dur")
        ranks = values.join(answers, ["service", "bucket"])
        ranks = ranks.groupBy("service", "bucket", "timed", "min_ms", "max_ms").agg(
            *[F.count_if(F.col("dur") < F.col(p)).alias(f"{p}_low") for p in _P],
            *[F.count_if(F.col("dur") <= F.col(p)).alias(f"{p}_high") for p in _P],
        )
        near = 3 * rollup.SKETCH_RANK_ERROR * F.col("timed") + 1
        held = [
            ((F.col(f"{p}_low") <= q * F.col("timed") + near) & (F.col(f"{p}_high") >= q * F.col("timed") - near)).alias(p)
            for p, q in rollup.QUANTILES.items()
        ]
        parts.append(ranks.select(F.lit(span).alias("span"), "service", "bucket", "timed", "min_ms", "max_ms", *held))
    return parts[0].unionByName(parts[1])


@query(
    ROLLUPS
    + """
    SELECT service, round(sum(p50_ms * w) / nullif(sum(w) FILTER (p50_ms IS NOT NULL), 0), 6) AS p50_ms,
           round(sum(p95_ms * w) / nullif(sum(w) FILTER (p95_ms IS NOT NULL), 0), 6) AS p95_ms,
           round(max(p95_ms), 6) AS worst_p95_ms
    FROM (SELECT *, greatest(coalesce(timed, 0), 1) AS w FROM log_rollup WHERE p95_ms IS NOT NULL)
    GROUP BY service"""
)
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = rollup.latency_summary(log_rollup(spark, sf_dir))
    return round_columns(summary, "p50_ms", "p95_ms", "worst_p95_ms")


# Late rows: a rollup made before the purchases arrived is corrected by recomputing buckets.
@query(
    ROLLUPS
    + _select_rounded(
        "log_rollup",
        "bucket, host, service, errors, warns, total, max_ms, timed, req_errors, apdex_s, apdex_t",
    )
)
def late_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = resolved(spark, sf_dir).filter(F.coalesce(F.col("phase"), F.lit("")) != "end")
    old = rollup.service_rollup(early)
    merged = tables.upsert(old, log_rollup(spark, sf_dir), ["bucket", "host", "service"])
    return round_columns(merged, *_P)


# -- error groups -----------------------------------------------------------------------------------

ERROR_CTES = ctes("logs", errors=ERRORS_SQL, stats=GROUPS_SQL, error_groups=TRIAGED_SQL)


@query(ctes("logs", errors=ERRORS_SQL) + "SELECT fp, id, ts, host, service, severity, sample FROM errors")
def error_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.error_rows(logs(spark, sf_dir))


@query(ERROR_CTES + "SELECT * FROM stats")
def error_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.group_stats(E.error_rows(logs(spark, sf_dir)))


@query(
    ERROR_CTES
    + """SELECT time_bucket(INTERVAL '5 minutes', ts) AS bucket, fp, count(*) AS occurrences
         FROM errors GROUP BY 1, 2"""
)
def error_group_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.group_buckets(E.error_rows(logs(spark, sf_dir)))


# Groups known by the 20th, then the rest of the month comes in.
_SPLIT = "2024-01-20 00:00:00"
_HALF_SQL = """
    SELECT fp, min(host) AS host, min(service) AS service, min(severity) AS severity,
           arg_max(left(sample, 500), (ts, id)) AS sample, min(ts) AS first_seen,
           max(ts) AS last_seen, count(*) AS occurrences
    FROM errors WHERE ts {} TIMESTAMP '2024-01-20 00:00:00' GROUP BY fp"""


@query(
    ctes("logs", errors=ERRORS_SQL, o=_HALF_SQL.format("<"), n=_HALF_SQL.format(">="))
    + f"""
    SELECT coalesce(o.fp, n.fp) AS fp, coalesce(o.host, n.host) AS host,
           coalesce(o.service, n.service) AS service, coalesce(o.severity, n.severity) AS severity,
           coalesce(n.sample, o.sample) AS sample,
           coalesce(o.first_seen, n.first_seen) AS first_seen,
           coalesce(n.last_seen, o.last_seen) AS last_seen,
           coalesce(o.occurrences, 0) + coalesce(n.occurrences, 0) AS occurrences,
           CASE WHEN o.fp IS NULL THEN 'open'
                WHEN n.fp IS NOT NULL AND {STATE_SQL.replace("fp", "o.fp")} = 'resolved' THEN 'open'
                ELSE {STATE_SQL.replace("fp", "o.fp")} END AS state
    FROM o FULL JOIN n ON o.fp = n.fp"""
)
def merged_error_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.error_rows(logs(spark, sf_dir))
    edge = F.lit(_SPLIT).cast("timestamp")
    old = E.group_stats(rows.filter(F.col("ts") < edge)).withColumn("state", F.expr(STATE_SQL))
    return E.merge_error_groups(old, E.group_stats(rows.filter(F.col("ts") >= edge)))


@query(
    ERROR_CTES
    + f"""
    SELECT g.fp, g.service, g.severity, g.state, count(*) AS in_window, any_value(g.occurrences) AS occurrences
    FROM errors e JOIN error_groups g USING (fp)
    WHERE time_bucket(INTERVAL '5 minutes', e.ts)
          > TIMESTAMP '{AS_OF}' - to_seconds({WEEK})
    GROUP BY 1, 2, 3, 4"""
)
def window_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = E.group_buckets(E.error_rows(logs(spark, sf_dir)))
    groups = triaged_groups(spark, sf_dir)
    return E.window_counts(recent(buckets, AS_OF, WEEK, "bucket"), groups)


@query(
    ERROR_CTES
    + """SELECT fp, host, service, severity, sample, first_seen, last_seen, occurrences, state
         FROM error_groups WHERE state <> 'ignored' ORDER BY last_seen DESC, fp LIMIT 100"""
)
def error_group_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.list_groups(triaged_groups(spark, sf_dir))


@query(
    ERROR_CTES
    + """SELECT fp, host, service, severity, sample, first_seen, last_seen, occurrences,
                CASE WHEN occurrences >= 5 THEN 'resolved' ELSE state END AS state
         FROM error_groups"""
)
def error_group_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = triaged_groups(spark, sf_dir)
    changes = groups.filter(F.col("occurrences") >= 5).select("fp", F.lit("resolved").alias("state"))
    return E.set_group_state(groups, changes)


