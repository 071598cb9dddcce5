"""The engine's input tables as views over the given benchmark tables.

Each view is SQL that Spark and DuckDB both run, so a query and its SQL check start from
the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.session import prepare

AS_OF = "2024-01-31 00:00:00"
# Look-back that covers all events up to AS_OF.
MONTH = 30 * 86400
WEEK = 7 * 86400
# Requests of the stand-in are hours apart, so pairs may be too.
PAIR_GAP = 5 * 3600

VIEWS = {
    "logs": """
        SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS ts,
               concat('host', CAST(user_id % 3 AS STRING)) AS host,
               concat('svc', CAST(user_id % 8 AS STRING)) AS service,
               'pm2' AS kind,
               CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN'
                    ELSE 'INFO' END AS severity,
               concat(event_type, ' failed for user ', CAST(user_id AS STRING),
                      ' code ', CAST(user_id % 5 AS STRING)) AS body,
               CASE WHEN event_type IN ('click', 'error', 'signup') THEN value * 20 END
                   AS duration_ms,
               CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN 500
                    WHEN event_type = 'error' THEN 404
                    WHEN event_type = 'signup' THEN 201 ELSE 200 END AS status,
               CASE WHEN event_type = 'signup' THEN 'POST'
                    WHEN event_type <> 'click' THEN 'GET' END AS method,
               CASE WHEN event_type <> 'purchase' THEN concat('/', event_type, '/:id') END
                   AS route,
               CAST(user_id AS STRING) AS req_id,
               CASE event_type WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'end' END AS phase
        FROM events""",
    "raw_lines": """
        SELECT event_id AS id,
               concat('/root/.pm2/logs/svc', CAST(user_id % 8 AS STRING),
                      CASE WHEN event_type = 'error' THEN '-error' ELSE '-out' END,
                      CASE WHEN user_id % 7 = 0 THEN '-3__2024-01-11_00-00-00' ELSE '' END,
                      '.log') AS file,
               concat('[', CAST(CAST(ts AS TIMESTAMP) AS STRING), '] method=GET url=/u/',
                      CAST(user_id AS STRING), '/', event_type, '?k=1 request_id=req-',
                      lpad(CAST(user_id AS STRING), 6, '0'),
                      CASE event_type WHEN 'view' THEN ' incoming request'
                           WHEN 'purchase' THEN ' request completed'
                           WHEN 'error' THEN ' FATAL token=abc' ELSE '' END,
                      CASE WHEN event_type = 'click'
                           THEN concat(' took=', CAST(CAST(floor(value) AS INT) AS STRING))
                           ELSE concat(' (', CAST(CAST(floor(value) AS INT) AS STRING),
                                       ' ms) 200') END) AS message
        FROM events""",
    "metrics": """
        SELECT CAST(ts AS TIMESTAMP) AS ts,
               concat('host', CAST(user_id % 3 AS STRING)) AS host,
               concat('svc', CAST(user_id % 8 AS STRING)) AS service,
               CASE WHEN user_id % 2 = 0 THEN 'pm2' ELSE 'docker' END AS kind,
               least(value / 4, 100.0) AS cpu,
               CAST(floor(value) AS BIGINT) * 40000000 AS mem_bytes,
               CAST(floor(event_id / 100) AS INT) AS restarts,
               CASE event_type WHEN 'error' THEN 'stopped' WHEN 'signup' THEN 'unhealthy'
                    ELSE 'online' END AS status
        FROM events""",
    "host_metrics": """
        SELECT CAST(ts AS TIMESTAMP) AS ts,
               concat('host', CAST(user_id % 3 AS STRING)) AS host,
               CAST(16000000000 AS BIGINT) AS mem_total,
               CAST(floor(value) AS BIGINT) * 30000000 AS mem_used,
               CAST(100000000000 AS BIGINT) AS disk_total,
               CAST(least(floor(value), 99) AS BIGINT) * 1000000000 AS disk_used
        FROM events WHERE event_type = 'view'""",
    "cert_expiry": """
        SELECT concat(lower(replace(s_name, '#', '-')), '.example.com') AS domain,
               CAST(s_suppkey % 40 AS INT) - 5 AS days_left
        FROM supplier""",
    "files": """
        SELECT o_orderkey AS inode, concat('svc', CAST(o_custkey % 8 AS STRING)) AS service,
               concat('/root/.pm2/logs/', CAST(o_orderkey AS STRING), '-out.log') AS path,
               CAST(floor(o_totalprice) AS BIGINT) AS size,
               CAST(o_orderdate AS TIMESTAMP) AS mtime
        FROM orders""",
    "positions": """
        SELECT l_orderkey AS inode, CAST(floor(sum(l_extendedprice)) AS BIGINT) AS position
        FROM lineitem GROUP BY l_orderkey""",
    "selected": """
        SELECT DISTINCT concat('svc', CAST(user_id % 5 AS STRING)) AS service FROM events""",
}


def base(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def from_sql(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Run SQL over base tables; every table named in `tables` is read from `sf_dir`."""
    prepare(spark)
    sql = sql.replace("{", "{{").replace("}", "}}")
    for table in tables:
        sql = sql.replace(f"FROM {table}", "FROM {" + table + "}")
    return spark.sql(sql, **{t: base(spark, sf_dir, t) for t in tables})


_BASE_OF = {
    "cert_expiry": "supplier",
    "files": "orders",
    "positions": "lineitem",
}
# What a sum of doubles gives just beside a whole number hangs on the order of its rows, and `floor`
# makes a whole step of it. Whole ten-thousandths add up to the same in any order.
_EXACT = {
    "positions": VIEWS["positions"].replace(
        "sum(l_extendedprice)", "sum(CAST(rint(l_extendedprice * 10000) AS BIGINT)) / 10000"
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return from_sql(spark, sf_dir, _EXACT.get(name, VIEWS[name]), _BASE_OF.get(name, "events"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in with its request facts packed into `attrs`."""
    facts = ["duration_ms", "status", "method", "route", "req_id", "phase"]
    flat = view(spark, sf_dir, "logs")
    packed = F.struct(*[F.col(f) for f in facts]).alias("attrs")
    return flat.select("id", "ts", "host", "service", "kind", "severity", "body", packed)


def ctes(*names: str, **more: str) -> str:
    """`WITH ...` for DuckDB: the named views and further ones given as SQL."""
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in names]
    parts += [f"{n} AS ({sql.strip()})" for n, sql in more.items()]
    return "WITH " + ",\n".join(parts) + "\n"
