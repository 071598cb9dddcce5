"""Alert conditions: what is measured per key, for each rule kind.

A condition returns (key, measure, value): `measure` is compared with the rule's threshold,
`value` is the rounded number people see. It does not depend on the threshold, so all rules
of one kind and window share one computation.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import text as X
from tidelog.functions.timing import in_time_range, is_recent, recent, utc

Tables = Mapping[str, DataFrame]
Moment = datetime | str

# Fixed values of the conditions.
HEALTHY = ["online", "running", "healthy"]
DOWN_MIN_WINDOW = 180
UNHEALTHY_MIN_WINDOW = 300
ENDPOINT_LATENCY_MIN_CALLS = 5
ENDPOINT_ERRORS_MIN_CALLS = 10
TRAFFIC_MIN_BASELINE = 100
IGNORED_PREFIX_CHARS = 40
HOST_KEY = "_host_"
KEY_SEP = "  "


def _measured(df: DataFrame, key: str, measure: Column, value: Column | None = None) -> DataFrame:
    value = measure if value is None else value
    return df.select(
        F.col(key).alias("key"),
        measure.cast("double").alias("measure"),
        value.cast("double").alias("value"),
    )


def not_ignored_counts(errors: DataFrame, groups: DataFrame) -> DataFrame:
    """(service, n) of error lines that do not start with an ignored group's sample.

    Lines are first counted by their first 40 characters. A head is then cut to the prefix
    lengths its service really has (almost always the one length 40), which turns
    "starts with" into an equality and the test into an ordinary equi join.
    """
    heads = errors.groupBy("service", F.left("body", F.lit(IGNORED_PREFIX_CHARS)).alias("head")).agg(
        F.count("*").alias("n")
    )
    ignored = (
        groups.filter(F.col("state") == "ignored")
        .select("service", F.left("sample", F.lit(IGNORED_PREFIX_CHARS)).alias("prefix"))
        .distinct()
    )
    lengths = ignored.groupBy("service").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    cut = (
        heads.join(lengths, "service", "left")
        .select("service", "head", "n", F.explode_outer("lengths").alias("size"))
        .withColumn("prefix", F.left("head", F.col("size")))
    )
    flagged = cut.join(ignored.withColumn("hit", F.lit(True)), ["service", "prefix"], "left")
    kept = flagged.groupBy("service", "head").agg(F.max("n").alias("n"), F.max("hit").alias("hit"))
    return kept.filter(F.col("hit").isNull()).groupBy("service").agg(F.sum("n").alias("n"))


def error_rate(t: Tables, window: int, as_of: Moment) -> DataFrame:
    errors = recent(t["log_entries"], as_of, window).filter(X.is_error(F.col("severity")))
    counts = not_ignored_counts(errors.select("service", "body"), t["error_groups"])
    return _measured(counts, "service", F.col("n"))


def crash_loop(t: Tables, window: int, as_of: Moment) -> DataFrame:
    """Restarts on one host; the worst host speaks for the service."""
    rows = recent(t["metrics"], as_of, window).filter(
        (F.col("kind") == "pm2") & F.col("restarts").isNotNull()
    )
    per_host = rows.groupBy("service", "host").agg((F.max("restarts") - F.min("restarts")).alias("n"))
    return _measured(per_host.groupBy("service").agg(F.max("n").alias("n")), "service", F.col("n"))


def _latest_status(t: Tables, seconds: int, as_of: Moment) -> DataFrame:
    """Newest status of every service on every host."""
    return (
        recent(t["metrics"], as_of, seconds)
        .groupBy("service", "host")
        .agg(F.max(F.struct("ts", "status")).alias("last"))
        .select("service", F.col("last.status").alias("status"))
    )


def service_down(t: Tables, window: int, as_of: Moment) -> DataFrame:
    """Services that are down on at least one host."""
    last = _latest_status(t, max(window, DOWN_MIN_WINDOW), as_of)
    down = last.filter(~F.col("status").isin(*HEALTHY)).select("service").distinct()
    return _measured(down, "service", F.lit(1))


def unhealthy(t: Tables, window: int, as_of: Moment) -> DataFrame:
    """Services that are unhealthy on at least one host."""
    last = _latest_status(t, max(window, UNHEALTHY_MIN_WINDOW), as_of)
    failing = last.filter(F.col("status") == "unhealthy").select("service").distinct()
    return _measured(failing, "service", F.lit(1))


def disk(t: Tables, window: int, as_of: Moment) -> DataFrame:
    """Newest sample of each host. The key always names the host, so that an alert keeps its
    key when other hosts come and go."""
    last = (
        recent(t["host_metrics"], as_of, window)
        .groupBy("host")
        .agg(F.max(F.struct("ts", "disk_used", "disk_total")).alias("l"))
        .withColumn("pct", F.lit(100.0) * F.col("l.disk_used") / F.nullif("l.disk_total", F.lit(0)))
    )
    key = F.concat(F.lit(HOST_KEY + ":"), F.coalesce("host", F.lit("unknown")))
    return _measured(last.withColumn("key", key), "key", F.col("pct"), F.round("pct"))


def cpu(t: Tables, window: int, as_of: Moment) -> DataFrame:
    rows = recent(t["metrics"], as_of, window).filter(F.col("cpu").isNotNull())
    mean = rows.groupBy("service").agg(F.avg("cpu").alias("v"))
    return _measured(mean, "service", F.col("v"), F.round("v", 1))


def memory(t: Tables, window: int, as_of: Moment) -> DataFrame:
    """Average memory as a share of the host's; the fullest host speaks for the service."""
    totals = recent(t["host_metrics"], as_of, window).groupBy("host").agg(
        F.max("mem_total").alias("mem_total")
    )
    used = (
        recent(t["metrics"], as_of, window)
        .filter(F.col("mem_bytes").isNotNull())
        .groupBy("host", "service")
        .agg(F.avg("mem_bytes").alias("mem"))
    )
    share = F.lit(100.0) * F.col("mem") / F.nullif("mem_total", F.lit(0))
    per_service = used.join(totals, "host").groupBy("service").agg(F.max(share).alias("v"))
    return _measured(per_service, "service", F.col("v"), F.round("v"))


def latency_p95(t: Tables, window: int, as_of: Moment) -> DataFrame:
    rows = recent(t["log_rollup"], as_of, window, "bucket").filter(F.col("p95_ms").isNotNull())
    worst = rows.groupBy("service").agg(F.max("p95_ms").alias("v"))
    return _measured(worst, "service", F.col("v"), F.round("v"))


def _endpoint_key() -> Column:
    return F.concat(
        F.col("service"), F.lit(KEY_SEP), F.trim(F.concat("method", F.lit(" "), "route"))
    )


def endpoint_latency(t: Tables, window: int, as_of: Moment) -> DataFrame:
    rows = recent(t["endpoint_rollup"], as_of, window, "bucket").filter(
        F.col("p95_ms").isNotNull()
    )
    worst = (
        rows.groupBy("service", "method", "route")
        .agg(F.sum("calls").alias("calls"), F.max("p95_ms").alias("v"))
        .filter(F.col("calls") >= ENDPOINT_LATENCY_MIN_CALLS)
        .withColumn("key", _endpoint_key())
    )
    return _measured(worst, "key", F.col("v"), F.round("v"))


def endpoint_errors(t: Tables, window: int, as_of: Moment) -> DataFrame:
    rows = recent(t["endpoint_rollup"], as_of, window, "bucket")
    share = F.lit(100.0) * F.col("errors") / F.nullif("calls", F.lit(0))
    failing = (
        rows.groupBy("service", "method", "route")
        .agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"))
        .filter(F.col("calls") >= ENDPOINT_ERRORS_MIN_CALLS)
        .withColumns({"key": _endpoint_key(), "v": share})
    )
    return _measured(failing, "key", F.col("v"), F.round("v"))


def traffic_drop(
    t: Tables, window: int, as_of: Moment, include_silent: bool = False
) -> DataFrame:
    """Requests now against the same window a week earlier, in percent below.

    One scan: both windows are summed side by side per service. A service without any
    bucket now does not fire unless `include_silent`.
    """
    week_ago = utc(as_of) - timedelta(days=7)
    rollup = t["log_rollup"]
    now = is_recent(rollup, as_of, window, "bucket")
    before = in_time_range(
        rollup, week_ago - timedelta(seconds=window), week_ago, "bucket",
        open_low=True, closed_high=True,
    )
    timed = F.coalesce("timed", F.lit(0))
    summed = (
        rollup.filter(now | before)
        .groupBy("service")
        .agg(F.sum(F.when(now, timed)).alias("c"), F.sum(F.when(before, timed)).alias("b"))
    )
    if include_silent:
        summed = summed.fillna(0, ["c"])
    drop = F.lit(100.0) * (F.col("b") - F.col("c")) / F.nullif("b", F.lit(0))
    kept = summed.filter(F.col("c").isNotNull() & (F.col("b") >= TRAFFIC_MIN_BASELINE))
    return _measured(kept.withColumn("v", drop), "service", F.col("v"), F.round("v"))


def cert_expiry(t: Tables, window: int, as_of: Moment) -> DataFrame:
    rows = t["cert_expiry"].filter(F.col("days_left").isNotNull())
    return _measured(rows, "domain", F.col("days_left"))


Condition = Callable[[Tables, int, Moment], DataFrame]

CONDITIONS: dict[str, Condition] = {
    "error_rate": error_rate,
    "crash_loop": crash_loop,
    "service_down": service_down,
    "unhealthy": unhealthy,
    "disk": disk,
    "cpu": cpu,
    "memory": memory,
    "latency_p95": latency_p95,
    "endpoint_latency": endpoint_latency,
    "endpoint_errors": endpoint_errors,
    "traffic_drop": traffic_drop,
    "cert_expiry": cert_expiry,
}

# Kinds that fire without comparing to the threshold, and the one that fires at or below it.
UNCONDITIONAL = {"service_down", "unhealthy"}
AT_OR_BELOW = {"cert_expiry"}


def fires(kind: str, threshold: Column) -> Column:
    """Whether a measured row is a firing one for a rule of this kind."""
    if kind in UNCONDITIONAL:
        return F.lit(True)
    if kind in AT_OR_BELOW:
        return F.col("measure") <= threshold
    return F.col("measure") > threshold
