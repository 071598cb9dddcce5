"""Queries for snapshots, retention, listings and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import diagnose as D
from tidelog.operators import metrics as M
from tidelog.operators import retention as R
from tidelog.operators import serve as S
from tidelog.plans.parse_queries import _parsed_lines
from tidelog.plans.registry import query
from tidelog.plans.rollup_queries import (
    ERROR_CTES,
    ROLLUPS,
    endpoint_rollup_table,
    log_rollup,
    triaged_groups,
)
from tidelog.plans.standins import AS_OF, MONTH, VIEWS, base, ctes, from_sql, logs, view

_NOW = f"TIMESTAMP '{AS_OF}'"
_SINCE = f"{_NOW} - to_seconds({MONTH})"
_FILES_NOW = "(SELECT max(mtime) FROM files)"

# -- snapshots ------------------------------------------------------------------------------------

_STATS = """
    SELECT p_brand AS host, concat(p_name, ' ', CAST(p_partkey AS STRING), '|',
             CASE WHEN p_size % 9 = 0 THEN '--' ELSE concat(CAST(p_size AS STRING), '.25%') END, '|',
             CASE p_size % 5 WHEN 0 THEN concat(CAST(p_size AS STRING), '.5MiB')
               WHEN 1 THEN concat(CAST(p_size AS STRING), 'GB') WHEN 2 THEN '12 kb'
               WHEN 3 THEN '7XB' ELSE 'n/a' END, ' / 2GiB') AS value
    FROM part"""
_STATUS = """
    SELECT p_brand AS host, concat(p_name, ' ', CAST(p_partkey AS STRING), '|Up 3 days',
             CASE p_partkey % 3 WHEN 0 THEN ' (unhealthy)' WHEN 1 THEN ' (healthy)' ELSE '' END) AS value
    FROM part WHERE p_partkey % 4 <> 0"""


@query(
    """SELECT TIMESTAMP '2024-01-01 00:00:00' AS ts, p_brand AS host,
              concat(p_name, ' ', p_partkey) AS service, 'docker' AS kind,
              CASE WHEN p_size % 9 = 0 THEN 0 ELSE p_size + 0.25 END::DOUBLE AS cpu,
              CAST(CASE p_size % 5 WHEN 0 THEN (p_size + 0.5) * 1048576 WHEN 1 THEN p_size * 1000000000.0
                   WHEN 2 THEN 12000 WHEN 3 THEN 7 ELSE 0 END AS BIGINT) AS mem_bytes,
              CAST(NULL AS INT) AS restarts,
              CASE WHEN p_partkey % 4 = 0 THEN 'running' WHEN p_partkey % 3 = 0 THEN 'unhealthy'
                   WHEN p_partkey % 3 = 1 THEN 'healthy' ELSE 'running' END AS status
       FROM part WHERE concat(p_name, ' ', p_partkey) <> 'red widget 1'"""
)
def container_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts")
    stats = from_sql(spark, sf_dir, _STATS, "part").select(at, "host", "value")
    statuses = M.container_health(from_sql(spark, sf_dir, _STATUS, "part"))
    return M.container_metrics(stats, statuses, skip="red widget 1")


@query(
    ctes("host_metrics")
    + """SELECT ts, host, CAST(NULL AS DOUBLE) AS cpu, mem_used / 1e9 AS load1, mem_used, mem_total,
                disk_used, disk_total FROM host_metrics"""
)
def host_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = view(spark, sf_dir, "host_metrics").withColumn("load1", (F.col("mem_used") / 1e9).cast("string"))
    texts = h.select("ts", "host", *[F.col(c).cast("string").alias(c) for c in h.columns[2:]])
    return M.host_samples(texts).drop("day")


# Query sessions from orders: five services, some in a transaction, some active.
_ACTIVITY = """
    SELECT concat('pg', CAST(o_custkey % 5 AS STRING)) AS service,
           CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'idle in transaction'
                ELSE 'idle' END AS state,
           CASE WHEN o_orderkey % 10 = 0 THEN 'select * from pg_stat_activity' ELSE o_orderpriority END
               AS query,
           CAST(o_orderdate AS TIMESTAMP) AS query_start
    FROM orders"""
_DATABASES = """
    SELECT concat('pg', CAST(c_custkey % 5 AS STRING)) AS service,
           CAST(floor(c_acctbal * 1000) AS BIGINT) AS size_bytes,
           CAST(c_custkey * 7 AS BIGINT) AS blks_hit, CAST(c_custkey AS BIGINT) AS blks_read
    FROM customer"""


@query(
    ctes(activity=_ACTIVITY, databases=_DATABASES)
    + f"""SELECT service, 'postgres' AS engine, metric, value FROM (
            SELECT service, CAST(count(*) AS DOUBLE) AS connections,
                   CAST(count(*) FILTER (state = 'idle in transaction') AS DOUBLE) AS idle_in_txn,
                   coalesce(round(max((epoch_us({_NOW}) - epoch_us(query_start)) / 1e6)
                     FILTER (state = 'active' AND NOT contains(query, 'pg_stat_activity'))), 0.0)
                     AS longest_query_s,
                   CAST(any_value(s) AS DOUBLE) AS size_bytes, any_value(h) AS cache_hit_pct
            FROM activity JOIN (SELECT service, sum(size_bytes) AS s,
                   round(100.0::DOUBLE * sum(blks_hit) / nullif(sum(blks_hit) + sum(blks_read), 0), 1) AS h
                   FROM databases GROUP BY 1) d USING (service) GROUP BY 1)
          UNPIVOT (value FOR metric IN (connections, idle_in_txn, longest_query_s, size_bytes, cache_hit_pct))"""
)
def postgres_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = M.postgres_metrics(
        from_sql(spark, sf_dir, _ACTIVITY, "orders"),
        from_sql(spark, sf_dir, _DATABASES, "customer"),
        AS_OF,
    )
    return M.long_form(wide, ["service"], "postgres", M.POSTGRES_METRICS)


_INFO = """
    SELECT concat(p_name, ' ', CAST(p_partkey AS STRING)) AS service,
           concat('# Memory', chr(13), chr(10), 'used_memory:', CAST(p_partkey * 10 AS STRING), chr(13),
                  chr(10), 'used_memory_peak:', CAST(p_partkey * 11 AS STRING), chr(10),
                  CASE WHEN p_size % 3 = 0 THEN '' ELSE concat('keyspace_hits:', CAST(p_size AS STRING),
                    chr(13), chr(10), 'keyspace_misses:', CAST(p_partkey % 7 AS STRING), chr(13), chr(10)) END,
                  'connected_clients:', CAST(p_size AS STRING)) AS info
    FROM part"""


@query(
    """SELECT service, 'redis' AS engine, metric, value FROM (
         SELECT concat(p_name, ' ', p_partkey) AS service, p_partkey * 10.0::DOUBLE AS used_memory_bytes,
                p_partkey * 11.0::DOUBLE AS peak_memory_bytes, p_size * 1.0::DOUBLE AS connected_clients,
                CASE WHEN p_size % 3 <> 0 AND p_size + p_partkey % 7 > 0
                     THEN 100 * p_size // (p_size + p_partkey % 7) END::DOUBLE AS hit_rate_pct
         FROM part)
       UNPIVOT (value FOR metric IN (used_memory_bytes, peak_memory_bytes, connected_clients, hit_rate_pct))"""
)
def redis_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = from_sql(spark, sf_dir, _INFO.replace("chr(", "char("), "part")
    return M.long_form(M.redis_metrics(info), ["service"], "redis", M.REDIS_METRICS)


@query(
    """SELECT service, 'mongo' AS engine, metric, value FROM (
         SELECT s_name AS service, s_suppkey * 1.0::DOUBLE AS connections_current,
                100.0::DOUBLE AS connections_avail, s_suppkey * 10.0::DOUBLE AS ops_total,
                CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE 0 END::DOUBLE AS resident_mb,
                coalesce(n, 0)::DOUBLE AS slow_ops
         FROM supplier LEFT JOIN (
           SELECT l_suppkey, count(*) FILTER (l_quantity >= 5 AND l_returnflag = 'A') AS n
           FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey)
       UNPIVOT (value FOR metric IN (connections_current, connections_avail, ops_total, resident_mb, slow_ops))"""
)
def mongo_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    supplier = base(spark, sf_dir, "supplier")
    status = supplier.select(
        F.col("s_name").alias("service"), key.alias("current"), F.lit(100).alias("available"),
        key.alias("query"), (key * 2).alias("insert"), (key * 3).alias("update"),
        (key * 4).alias("delete"), F.when(key % 2 == 0, key).alias("resident"),
    )
    names = supplier.select(key.alias("l_suppkey"), F.col("s_name").alias("service"))
    operations = base(spark, sf_dir, "lineitem").join(names, "l_suppkey").select(
        "service", F.col("l_quantity").alias("secs_running"), (F.col("l_returnflag") == "A").alias("active")
    )
    return M.long_form(M.mongo_metrics(status, operations), ["service"], "mongo", M.MONGO_METRICS)


@query(
    r"""WITH names AS (
          SELECT DISTINCT concat('host', page_id % 3) AS host, d AS domain
          FROM pages, unnest([regexp_extract(url, '^https?://([^/]+)', 1),
                              concat('www.', regexp_extract(url, '^https?://([^/]+)', 1))]) AS t(d)
          WHERE contains(d, '.') AND NOT regexp_matches(d, '^(_|localhost|\*)'))
        SELECT host, domain FROM names
        QUALIFY row_number() OVER (PARTITION BY host ORDER BY domain) <= 50"""
)
def vhost_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = F.regexp_extract("url", "^https?://([^/]+)", 1)
    line = F.concat(
        F.lit("  server_name _ localhost *.x.org "), domain, F.lit(" www."), domain, F.lit("; # "), "url"
    )
    host = F.concat(F.lit("host"), (F.col("page_id") % 3).cast("string"))
    pages = base(spark, sf_dir, "pages")
    return M.vhost_domains(pages.select(host.alias("host"), line.alias("value")))


# Certificates: those of order dates are on record; a part of the domains is probed again.
@query(
    f"""WITH o AS (SELECT s_suppkey, concat('d', s_suppkey, '.example.com') AS domain,
                          concat('host', s_suppkey % 3) AS host,
                          TIMESTAMP '2024-03-01 00:00:00' + to_days(CAST(s_suppkey % 90 AS INT)) AS not_after
                   FROM supplier WHERE s_suppkey % 4 <> 0),
             n AS (SELECT s_suppkey, concat('d', s_suppkey, '.example.com') AS domain,
                          concat('host', s_suppkey % 3) AS host,
                          CASE WHEN s_suppkey % 3 <> 0
                               THEN TIMESTAMP '2024-01-20 12:00:00' + to_days(CAST(s_suppkey % 90 AS INT)) END
                            AS not_after
                   FROM supplier WHERE s_suppkey % 2 = 0)
        SELECT coalesce(o.domain, n.domain) AS domain, coalesce(o.host, n.host) AS host,
               coalesce(n.not_after, o.not_after) AS not_after,
               CAST(trunc(epoch(coalesce(n.not_after, o.not_after)
                    - CASE WHEN n.not_after IS NULL THEN TIMESTAMP '2024-01-10 00:00:00' ELSE {_NOW} END) / 86400)
                    AS INT) AS days_left,
               CASE WHEN n.not_after IS NOT NULL THEN 'new CA' WHEN o.domain IS NOT NULL THEN 'old CA' END AS issuer,
               CASE WHEN n.domain IS NOT NULL THEN {_NOW} ELSE TIMESTAMP '2024-01-10 00:00:00' END AS checked_at,
               CASE WHEN n.domain IS NOT NULL AND n.not_after IS NULL THEN 'unreachable' END AS error
        FROM o FULL JOIN n ON o.domain = n.domain"""
)
def certificate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    days = F.make_dt_interval((key % 90).cast("int"))

    def probe(keep, start: str, known, issuer: str) -> DataFrame:
        expiry = F.lit(start).cast("timestamp") + days
        return base(spark, sf_dir, "supplier").filter(keep).select(
            F.concat(F.lit("d"), key.cast("string"), F.lit(".example.com")).alias("domain"),
            F.concat(F.lit("host"), (key % 3).cast("string")).alias("host"),
            F.when(known, expiry).alias("not_after"),
            F.lit(issuer).alias("issuer"),
        )

    old = probe(key % 4 != 0, "2024-03-01 00:00:00", F.lit(True), "old CA")
    new = probe(key % 2 == 0, "2024-01-20 12:00:00", key % 3 != 0, "new CA")
    return M.merge_certificates(
        M.certificate_checks(old, "2024-01-10 00:00:00"), M.certificate_checks(new, AS_OF)
    )


# -- retention -----------------------------------------------------------------------------------------


@query(
    ROLLUPS
    + """SELECT bucket, host, service, total FROM log_rollup
         WHERE bucket >= TIMESTAMP '2024-04-10 00:00:00' - INTERVAL 90 DAY"""
)
def pruned_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = R.prune_rows(log_rollup(spark, sf_dir), "log_rollup", "2024-04-10 00:00:00")
    return kept.select("bucket", "host", "service", "total")


def _host_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs(spark, sf_dir)
    return rows.select("host", F.lit("log_entries").alias("tbl"), F.to_date("ts").alias("day")).distinct()


@query(
    ctes("logs")
    + """, free AS (SELECT host, CAST(7 + 3 * row_number() OVER (ORDER BY host) - 3 AS INT) AS free_pct
                    FROM (SELECT DISTINCT host FROM logs)),
           days AS (SELECT DISTINCT host, CAST(ts AS DATE) AS day FROM logs),
           ranked AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY day) AS n FROM days)
         SELECT host, free_pct, 'emergency_drop' AS action, 'log_entries' AS tbl, day
         FROM ranked JOIN free USING (host)
         WHERE n <= CASE WHEN free_pct < 8 THEN 0 WHEN free_pct < 10 THEN 2 WHEN free_pct < 15 THEN 1 ELSE 0 END
         UNION ALL SELECT host, free_pct, 'paused', NULL, NULL FROM free WHERE free_pct < 8"""
)
def pressure_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _host_days(spark, sf_dir)
    number = F.regexp_extract("host", r"(\d+)", 1).cast("int")
    free = days.select("host", (number * 3 + 7).alias("free_pct")).distinct()
    return R.pressure_plan(days, free)


@query(
    ctes("logs")
    + """SELECT tbl, CAST(d AS DATE) AS day FROM (SELECT DISTINCT service AS tbl FROM logs),
              generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-06', INTERVAL 1 DAY) AS g(d)
         WHERE (tbl, CAST(d AS DATE)) NOT IN (SELECT service, CAST(ts AS DATE) FROM logs)"""
)
def missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = logs(spark, sf_dir).select(F.col("service").alias("tbl"), F.to_date("ts").alias("day"))
    return R.missing_days(present, "2024-01-01", "2024-02-06")


# -- listings -----------------------------------------------------------------------------------------------

_LOG_COLUMNS = ["id", "ts", "host", "service", "severity", "body"]
_COLUMNS = ", ".join(_LOG_COLUMNS)


@query(
    ctes("logs")
    + f"""SELECT {_COLUMNS} FROM logs WHERE (ts, id) < (TIMESTAMP '2024-01-20 00:00:00', 7000)
          ORDER BY ts DESC, id DESC LIMIT 200"""
)
def log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.page(logs(spark, sf_dir).select(*_LOG_COLUMNS), "2024-01-20 00:00:00", 7000)


@query(ctes("logs") + f"SELECT service, kind, count(*) AS n FROM logs WHERE ts > {_SINCE} GROUP BY 1, 2")
def log_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.volume(logs(spark, sf_dir), AS_OF, MONTH)


@query(
    ctes("logs")
    + f"SELECT {_COLUMNS} FROM logs WHERE body ILIKE '%ERROR FAILED%code 3%' ORDER BY ts DESC, id DESC LIMIT 50"
)
def body_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(logs(spark, sf_dir).select(*_LOG_COLUMNS), "%ERROR FAILED%code 3%")


@query(
    """SELECT doc_id AS id, md5(text) AS body_md5 FROM documents
       WHERE regexp_matches(text, '(?i)(password|secret|token|bearer|AKIA|eyJ)')
       ORDER BY doc_id DESC LIMIT 20"""
)
def secret_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.col("text").alias("body")
    )
    return S.secret_audit(docs).select("id", F.md5("body").alias("body_md5"))


@query(
    ctes("logs")
    + "SELECT CAST(ts AS DATE) AS day, count(*) AS n, min(ts) AS oldest, max(ts) AS newest FROM logs GROUP BY 1"
)
def rows_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rows_per_day(logs(spark, sf_dir))


_EVENT_STATE = """
    SELECT CAST(user_id AS INT) AS rule_id, CASE WHEN event_type = 'error' THEN 'firing' ELSE 'resolved' END AS state
    FROM events"""


@query(
    ERROR_CTES
    + """SELECT (SELECT count(*) FROM logs) AS n_rows, (SELECT min(ts) FROM logs) AS oldest,
                (SELECT max(ts) FROM logs) AS newest,
                (SELECT count(*) FROM events WHERE event_type = 'error') AS firing,
                (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS enabled_rules,
                (SELECT count(*) FROM error_groups WHERE state = 'open') AS open_groups"""
)
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = from_sql(spark, sf_dir, _EVENT_STATE, "events")
    rules = base(spark, sf_dir, "supplier").select((F.col("s_acctbal") > 0).alias("enabled"))
    return S.store_stats(logs(spark, sf_dir), state, rules, triaged_groups(spark, sf_dir))


_MAINTENANCE = """
    SELECT CAST(o_orderdate AS TIMESTAMP) AS ts,
           CASE o_orderstatus WHEN 'F' THEN 'drop_partition' WHEN 'O' THEN 'purge' ELSE 'paused' END AS action,
           CASE WHEN o_orderkey % 3 <> 0 THEN concat('order ', CAST(o_orderkey AS STRING)) END AS detail
    FROM orders"""


@query(
    ctes(log=_MAINTENANCE)
    + """SELECT (SELECT max(ts) FROM log WHERE action = 'drop_partition') AS last_cleanup,
                (SELECT max(CAST(ts AS DATE)) FROM events) AS partitions_through,
                (SELECT string_agg(e, '; ' ORDER BY ts DESC, e DESC) FROM (
                   SELECT ts, concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), ' ', action, ' ', coalesce(detail, '')) AS e
                   FROM log ORDER BY ts DESC, action, detail NULLS FIRST LIMIT 5)) AS recent"""
)
def maintenance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = base(spark, sf_dir, "events").select(F.to_date("ts").alias("day"))
    summary = S.maintenance_summary(from_sql(spark, sf_dir, _MAINTENANCE, "orders"), present)
    return summary.withColumn("recent", F.array_join("recent", "; "))


@query(
    ctes("selected")
    + """SELECT service, kind, status, restarts, service IN (SELECT service FROM selected) AS enabled FROM (
           SELECT concat('svc', CAST(s_suppkey % 8 AS VARCHAR)) AS service, 'pm2' AS kind,
                  'online' AS status, s_nationkey AS restarts FROM supplier
           UNION ALL
           SELECT p_name, 'docker', CASE WHEN p_size % 2 = 0 THEN 'unhealthy' ELSE 'running' END, NULL
           FROM part WHERE p_name <> 'red widget')"""
)
def discovered_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    processes = base(spark, sf_dir, "supplier").select(
        F.concat(F.lit("svc"), (F.col("s_suppkey") % 8).cast("string")).alias("service"),
        F.lit("online").alias("status"),
        F.col("s_nationkey").alias("restarts"),
    )
    text = F.when(F.col("p_size") % 2 == 0, F.lit("Up 2h (unhealthy)")).otherwise(F.lit("Up 2h (healthy)"))
    containers = base(spark, sf_dir, "part").select(F.col("p_name").alias("service"), text.alias("status_text"))
    return S.discovered(processes, containers, view(spark, sf_dir, "selected"), own="red widget")


@query(
    ctes("raw_lines")
    + r"""SELECT service, count(*) AS n FROM (
            SELECT regexp_replace(regexp_extract(file, '([^/]+)$', 1),
                   '-(out|error)(-\d+)?(__[^/]*)?\.log$', '') AS service, file FROM raw_lines)
          WHERE NOT regexp_matches(file, '__\d{4}-') AND (contains(service, 'svc1') OR contains(service, '5'))
          GROUP BY 1"""
)
def live_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.operators.parse import service_and_kind

    named = service_and_kind(view(spark, sf_dir, "raw_lines"))
    live = view(spark, sf_dir, "metrics").select("service").distinct()
    return S.tail_stream(named, ["svc1", "5"], live).groupBy("service").agg(F.count("*").alias("n"))


@query(
    ERROR_CTES
    + """SELECT fp, json_extract_string(j, '$.service') AS service,
                CAST(json_extract(j, '$.occurrences') AS BIGINT) AS occurrences
         FROM (SELECT fp, to_json({'fp': fp, 'service': service, 'occurrences': occurrences}) AS j
               FROM error_groups WHERE state <> 'ignored' ORDER BY last_seen DESC, fp LIMIT 100)"""
)
def json_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.operators.errors import list_groups

    listing = list_groups(triaged_groups(spark, sf_dir)).select("fp", "service", "occurrences")
    packed = S.json_array(listing, 100)
    items = F.explode(F.from_json("json", "array<struct<fp: string, service: string, occurrences: bigint>>"))
    return packed.select(items.alias("i")).select("i.*")


# -- diagnostics ---------------------------------------------------------------------------------------------


@query(
    ctes("metrics")
    + f"""SELECT count(*) AS samples, count(DISTINCT service) FILTER (kind = 'pm2') AS pm2_services,
                 count(DISTINCT service) FILTER (kind = 'docker') AS docker_services
          FROM metrics WHERE ts > {_SINCE}"""
)
def metric_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.metric_freshness(view(spark, sf_dir, "metrics"), AS_OF, MONTH)


@query(
    ctes("logs")
    + f"""SELECT count(status) AS with_status, count(method) AS with_method, count(route) AS with_route,
                 count(*) FILTER (phase = 'start') AS starts, count(*) FILTER (phase = 'end') AS ends,
                 count(req_id) AS with_req_id FROM logs WHERE ts > {_SINCE}"""
)
def parser_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.parser_yield(logs(spark, sf_dir), AS_OF, MONTH)


@query(ctes("logs") + "SELECT count(*) AS n FROM logs WHERE ts > TIMESTAMP '2024-01-09 12:00:00'")
def rows_since_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.rows_since(logs(spark, sf_dir), "2024-01-09 12:00:00")


@query(ctes("logs") + f"SELECT count(*) AS n_lines, count(duration_ms) AS timed FROM logs WHERE ts > {_SINCE}")
def timed_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.timed_share(logs(spark, sf_dir), AS_OF, MONTH)


@query(
    ctes("logs")
    + f"""SELECT service, round(quantile_cont(duration_ms, 0.50), 6) AS p50_ms,
                 round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms, count(*) AS timed
          FROM logs WHERE ts > {_SINCE} AND duration_ms IS NOT NULL GROUP BY 1"""
)
def raw_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    latency = D.raw_latency(logs(spark, sf_dir), AS_OF, MONTH)
    return latency.withColumns({c: F.round(c, 6) for c in ("p50_ms", "p95_ms")})


_TIMING = (
    r"([A-Za-z_.]*(?:[Dd]uration|[Ee]lapsed|[Ll]atency|[Rr]esponse[Tt]ime|[Tt]ook|_ms|[Mm]illis)"
    r"[A-Za-z_.]*)\"?\s*[=:]\s*\"?([0-9]+(?:\.[0-9]+)?)"
)


@query(
    ctes("raw_lines")
    + f"""SELECT DISTINCT field, value FROM (
            SELECT unnest(regexp_extract_all(message, '{_TIMING}', 1)) AS field,
                   unnest(regexp_extract_all(message, '{_TIMING}', 2)) AS value FROM raw_lines)
          ORDER BY field, value LIMIT 20"""
)
def timing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.timing_fields(_parsed_lines(spark, sf_dir), AS_OF, MONTH)


@query(
    ctes("raw_lines", "logs")
    + """SELECT r.id, l.ts FROM raw_lines r JOIN logs l USING (id) WHERE r.message ILIKE '%request completed%'
         ORDER BY l.ts DESC, r.id DESC LIMIT 2"""
)
def request_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.request_records(_parsed_lines(spark, sf_dir), AS_OF, MONTH).select("id", "ts")


@query(
    ctes("raw_lines")
    + r"""SELECT service, count(*) AS n_lines,
                 count(*) FILTER (regexp_matches(message, '\(\d+ ms\)|took=')) AS timed,
                 count(*) FILTER (contains(message, 'request completed')) AS ended, count(*) AS with_id,
                 'pairs' AS source
          FROM (SELECT regexp_extract(file, '(svc\d)', 1) AS service, message FROM raw_lines) GROUP BY 1"""
)
def latency_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.latency_explained(_parsed_lines(spark, sf_dir), AS_OF, MONTH)


def _files_now(spark: SparkSession, sf_dir: str) -> str:
    return view(spark, sf_dir, "files").agg(F.max("mtime").cast("string").alias("t")).first()["t"]


# Selected services: some with logs and files, some with files but no logs, some with neither.
_WIDE_FILES = VIEWS["files"].replace("o_custkey % 8", "o_custkey % 12")
_WIDE_SELECTED = "SELECT DISTINCT concat('svc', CAST(o_custkey % 14 AS STRING)) AS service FROM orders"


def _wide(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tuple(from_sql(spark, sf_dir, sql, "orders") for sql in (_WIDE_SELECTED, _WIDE_FILES))


# "Now" is the newest file write, long before the logs, so all of them count as recent.
@query(
    ctes("logs", files=_WIDE_FILES, selected=_WIDE_SELECTED)
    + f""", newest AS (SELECT service, arg_max(path, (mtime, path, size)) AS path,
                              arg_max(size, (mtime, path, size)) AS size, max(mtime) AS mtime
                       FROM files GROUP BY 1)
         SELECT *, CASE WHEN age_secs IS NULL THEN 'no log file'
                     WHEN n_rows > 0 THEN 'collected' WHEN age_secs > 3600 THEN 'service is silent'
                     WHEN age_secs < 600 THEN 'WRITTEN BUT NOT COLLECTED' ELSE 'no rows yet' END AS verdict
         FROM (SELECT s.service, coalesce(n, 0) AS n_rows, path, size,
                      CAST(epoch({_FILES_NOW}) - epoch(mtime) AS BIGINT) AS age_secs
               FROM selected s LEFT JOIN newest USING (service)
               LEFT JOIN (SELECT service, count(*) AS n FROM logs WHERE ts > {_FILES_NOW} - INTERVAL '1 hour' GROUP BY 1) USING (service))"""
)
def selected_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    containers = base(spark, sf_dir, "part").select(F.col("p_name").alias("service"))
    selected, files = _wide(spark, sf_dir)
    return D.selected_activity(selected, logs(spark, sf_dir), files, containers, _files_now(spark, sf_dir))


_VERDICT_WINDOW = f"epoch({_FILES_NOW}) - epoch(mtime)"


@query(
    ctes("files", "positions", "selected")
    + f"""SELECT inode, service, path, size, mtime, position,
                 CASE WHEN service NOT IN (SELECT service FROM selected) THEN 'DROPPED'
                      WHEN position IS NULL THEN 'collected, no checkpoint yet'
                      WHEN position > size THEN 'STALLED' ELSE 'collected' END AS verdict
          FROM files LEFT JOIN positions USING (inode) WHERE {_VERDICT_WINDOW} < 600"""
)
def file_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.file_verdicts(
        view(spark, sf_dir, "files"), view(spark, sf_dir, "positions"),
        view(spark, sf_dir, "selected"), _files_now(spark, sf_dir),
    )


@query(
    ctes("files", "positions")
    + f"""SELECT inode, service, path, size, mtime, position FROM files JOIN positions USING (inode)
          WHERE position > size AND {_VERDICT_WINDOW} <= 600"""
)
def stalled_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.stalled_positions(
        view(spark, sf_dir, "files"), view(spark, sf_dir, "positions"), _files_now(spark, sf_dir)
    )


@query(
    ctes("logs", files=_WIDE_FILES, selected=_WIDE_SELECTED)
    + f""", newest AS (SELECT service, arg_max(path, (mtime, path, size)) AS path, max(mtime) AS mtime
                       FROM files GROUP BY 1)
         SELECT service, path, CAST({_VERDICT_WINDOW} AS BIGINT) AS age_secs
         FROM newest JOIN selected USING (service) WHERE {_VERDICT_WINDOW} < 120 AND service NOT IN
           (SELECT service FROM logs WHERE ts > {_FILES_NOW} - INTERVAL '15 minutes')"""
)
def silent_while_writing(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected, files = _wide(spark, sf_dir)
    return D.silent_while_writing(selected, logs(spark, sf_dir), files, _files_now(spark, sf_dir))


@query(
    ROLLUPS
    + """SELECT newest_row, newest_bucket, round((epoch_us(newest_row) - epoch_us(newest_bucket)) / 60e6) AS lag_minutes,
                'current' AS verdict
         FROM (SELECT (SELECT max(ts) FROM logs) AS newest_row, (SELECT max(bucket) FROM log_rollup) AS newest_bucket)"""
)
def rollup_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.rollup_lag(logs(spark, sf_dir), log_rollup(spark, sf_dir))


@query(
    ROLLUPS
    + f"""SELECT method, route, CAST(sum(calls) AS BIGINT) AS calls, round(100.0::DOUBLE * sum(errors) / sum(calls), 1) AS error_pct,
                 round(max(p95_ms), 6) AS worst_p95_ms FROM endpoint_rollup WHERE bucket > {_SINCE}
          GROUP BY 1, 2 ORDER BY calls DESC, method, route LIMIT 5"""
)
def top_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = D.top_endpoints(endpoint_rollup_table(spark, sf_dir), AS_OF, MONTH)
    return top.withColumn("worst_p95_ms", F.round("worst_p95_ms", 6))


