"""Snapshots of processes, containers, databases and certificates to metric rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import patterns as P
from tidelog.functions import text as X
from tidelog.functions.timing import instant
from tidelog.operators.parse import process_list

Moment = datetime | str

# Fixed values
SLOW_OP_SECONDS = 5
DOMAINS_PER_HOST = 50
UNREACHABLE = "unreachable"


def host_samples(snapshots: DataFrame) -> DataFrame:
    """Host snapshots (ts, host, load1, mem_used, mem_total, disk_used, disk_total as text or
    numbers) to `host_metrics`. The snapshot holds no cpu figure."""

    def number(name: str, kind: str) -> Column:
        return F.col(name).try_cast(kind).alias(name)

    return snapshots.select(
        F.col("ts").cast("timestamp").alias("ts"),
        "host",
        F.lit(None).cast("double").alias("cpu"),
        number("load1", "double"),
        *[number(n, "bigint") for n in ("mem_used", "mem_total", "disk_used", "disk_total")],
        F.to_date(F.col("ts").cast("timestamp")).alias("day"),
    )


def process_metrics(snapshots: DataFrame, column: str = "value") -> DataFrame:
    """Process-list JSON with its ts and host to `metrics`; nameless processes are skipped."""
    zero = F.lit(0)
    return process_list(snapshots.select("ts", "host", column), column).select(
        "ts",
        "host",
        F.col("p.name").alias("service"),
        F.lit("pm2").alias("kind"),
        F.coalesce("p.monit.cpu", zero.cast("double")).alias("cpu"),
        F.coalesce("p.monit.memory", zero.cast("bigint")).alias("mem_bytes"),
        F.coalesce("p.pm2_env.restart_time", zero).alias("restarts"),
        F.coalesce("p.pm2_env.status", F.lit("")).alias("status"),
    )


def health(status_text: Column) -> Column:
    return (
        F.when(F.contains(status_text, F.lit("unhealthy")), F.lit("unhealthy"))
        .when(F.contains(status_text, F.lit("healthy")), F.lit("healthy"))
        .otherwise(F.lit("running"))
    )


def container_health(lines: DataFrame, column: str = "value") -> DataFrame:
    """`name|status text` lines to (host, service, status). The last `|`-less lines are noise."""
    line = F.col(column)
    return (
        lines.filter(F.contains(line, F.lit("|")))
        .select(
            "host",
            F.substring_index(line, "|", 1).alias("service"),
            health(F.regexp_replace(line, r"(?s)^[^|]*\|", "")).alias("status"),
        )
        .dropDuplicates(["host", "service"])
    )


def container_metrics(
    stats: DataFrame, statuses: DataFrame, skip: str = "", column: str = "value"
) -> DataFrame:
    """`name|cpu%|used / limit` lines (with ts, host) plus health to `metrics`."""
    parts = F.split(F.trim(F.col(column)), r"\|")
    rows = (
        stats.withColumn("p", parts)
        .filter((F.size("p") >= 3) & (F.col("p")[0] != skip))
        .select(
            "ts",
            "host",
            F.col("p")[0].alias("service"),
            F.coalesce(
                F.replace(F.col("p")[1], F.lit("%"), F.lit("")).try_cast("double"), F.lit(0.0)
            ).alias("cpu"),
            X.size_bytes(F.substring_index(F.col("p")[2], "/", 1)).alias("mem_bytes"),
        )
    )
    known = statuses.withColumnRenamed("status", "_status")
    return rows.join(known, ["host", "service"], "left").select(
        "ts",
        "host",
        "service",
        F.lit("docker").alias("kind"),
        "cpu",
        "mem_bytes",
        F.lit(None).cast("int").alias("restarts"),
        F.coalesce("_status", F.lit("running")).alias("status"),
    )


def long_form(wide: DataFrame, ids: list[str], engine: str, metrics: list[str]) -> DataFrame:
    """One row per measured value; a value that could not be read makes no row."""
    return (
        wide.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
        .unpivot(ids, metrics, "metric", "value")
        .filter(F.col("value").isNotNull())
        .select(*ids, F.lit(engine).alias("engine"), "metric", "value")
    )


def postgres_metrics(
    activity: DataFrame, databases: DataFrame, as_of: Moment, statements: DataFrame | None = None
) -> DataFrame:
    """Wide figures per service from landed activity, database and statement snapshots.

    activity: service, state, query, query_start. databases: service, size_bytes, blks_hit,
    blks_read. statements (optional): service, mean_exec_time.
    """
    age = (F.unix_micros(instant(as_of)) - F.unix_micros("query_start")) / 1e6
    own = F.contains("query", F.lit("pg_stat_activity"))
    longest = F.max(F.when((F.col("state") == "active") & ~own, age))
    sessions = activity.groupBy("service").agg(
        F.count("*").alias("connections"),
        F.count_if(F.col("state") == "idle in transaction").alias("idle_in_txn"),
        F.coalesce(F.round(longest), F.lit(0.0)).alias("longest_query_s"),
    )
    hits, reads = F.sum("blks_hit"), F.sum("blks_read")
    sizes = databases.groupBy("service").agg(
        F.sum("size_bytes").alias("size_bytes"),
        F.round(F.lit(100.0) * hits / F.nullif(hits + reads, F.lit(0)), 1).alias("cache_hit_pct"),
    )
    wide = sessions.join(sizes, "service", "full_outer")
    if statements is None:
        return wide.withColumn("slowest_mean_ms", F.lit(None).cast("double"))
    slow = statements.groupBy("service").agg(F.round(F.max("mean_exec_time")).alias("slowest_mean_ms"))
    return wide.join(slow, "service", "left")


POSTGRES_METRICS = [
    "connections", "idle_in_txn", "longest_query_s", "size_bytes", "cache_hit_pct",
    "slowest_mean_ms",
]

# Info field -> metric name
REDIS_FIELDS = {
    "used_memory": "used_memory_bytes",
    "used_memory_peak": "peak_memory_bytes",
    "evicted_keys": "evicted_keys",
    "connected_clients": "connected_clients",
    "blocked_clients": "blocked_clients",
}
REDIS_METRICS = [*REDIS_FIELDS.values(), "hit_rate_pct"]


def redis_metrics(info: DataFrame, column: str = "info") -> DataFrame:
    """`key:value` info text to one wide row; the hit rate is a whole percentage."""
    text = F.replace(F.col(column), F.lit("\r"), F.lit(""))

    def field(name: str) -> Column:
        return X.extract(text, rf"(?m)^{name}:([^:\n]*)", 1).try_cast("bigint")

    hits, misses = field("keyspace_hits"), field("keyspace_misses")
    rate = F.when(hits + misses > 0, F.floor(F.lit(100) * hits / (hits + misses)).cast("bigint"))
    others = [c for c in info.columns if c != column]
    return info.select(
        *others, *[field(k).alias(v) for k, v in REDIS_FIELDS.items()], rate.alias("hit_rate_pct")
    )


MONGO_METRICS = [
    "connections_current", "connections_avail", "ops_total", "resident_mb", "slow_ops",
]


def mongo_metrics(status: DataFrame, operations: DataFrame) -> DataFrame:
    """status: service, current, available, the four op counters, resident.
    operations: service, secs_running, active."""
    slow = operations.groupBy("service").agg(
        F.count_if(
            (F.col("secs_running") >= SLOW_OP_SECONDS) & F.coalesce("active", F.lit(False))
        ).alias("slow_ops")
    )
    return status.join(slow, "service", "left").select(
        "service",
        F.col("current").alias("connections_current"),
        F.col("available").alias("connections_avail"),
        (F.col("query") + F.col("insert") + F.col("update") + F.col("delete")).alias("ops_total"),
        F.coalesce("resident", F.lit(0)).alias("resident_mb"),
        F.coalesce("slow_ops", F.lit(0)).alias("slow_ops"),
    )


def vhost_domains(
    lines: DataFrame, column: str = "value", per_host: int = DOMAINS_PER_HOST
) -> DataFrame:
    """(host, domain) named by `server_name` lines, the first 50 of each host by name."""
    names = (
        lines.select("host", X.extract(F.col(column), P.SERVER_NAME, 1).alias("names"))
        .select("host", F.explode(F.split("names", " ")).alias("domain"))
        .filter(~F.col("domain").rlike(P.SKIPPED_DOMAIN) & F.contains("domain", F.lit(".")))
        .distinct()
    )
    order = Window.partitionBy("host").orderBy("domain")
    return (
        names.withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= per_host)
        .select("host", "domain")
    )


def certificate_checks(probed: DataFrame, as_of: Moment) -> DataFrame:
    """Probe results (domain, host, not_after, issuer) with days left, truncated toward zero.
    No expiry date means the host could not be reached."""
    left = F.unix_seconds("not_after") - F.unix_seconds(instant(as_of))
    reached = F.col("not_after").isNotNull()
    return probed.select(
        "domain",
        "host",
        "not_after",
        F.when(left < 0, F.ceil(left / 86400)).otherwise(F.floor(left / 86400)).cast("int").alias(
            "days_left"
        ),
        F.when(reached, F.left("issuer", F.lit(100))).alias("issuer"),
        instant(as_of).alias("checked_at"),
        F.when(~reached, F.lit(UNREACHABLE)).alias("error"),
    )


def merge_certificates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by domain; an unreachable host only updates when and why, and keeps its expiry."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.domain") == F.col("n.domain"), "full_outer")
    checked = F.col("n.domain").isNotNull()
    renewed = checked & F.col("n.error").isNull()

    def pick(name: str, when: Column) -> Column:
        return F.when(when, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}")).alias(name)

    return both.select(
        F.coalesce("o.domain", "n.domain").alias("domain"),
        F.coalesce("o.host", "n.host").alias("host"),
        pick("not_after", renewed),
        pick("days_left", renewed),
        pick("issuer", renewed),
        pick("checked_at", checked),
        pick("error", checked),
    )
