"""Request latency from pairs of lines: an as-of join bounded to a maximum gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_GAP_SECONDS = 300


def pair_requests(logs: DataFrame, max_gap_seconds: int = MAX_GAP_SECONDS) -> DataFrame:
    """(service, req_id, ts, gap_ms, route, method): the latest start of each end line.

    A start pairs when it has the same service and request id and lies in
    (end - gap, end]. Work is done on distinct moments, so a request id written by half of
    all lines is reduced before the shuffle, and its time axis is cut into slots as long as
    the gap: an end looks into its own slot and the one before, hence every start is handed
    to two slots.
    """
    gap = max_gap_seconds * 1_000_000
    requests = logs.select(
        "service",
        F.col("attrs.req_id").alias("req_id"),
        "ts",
        "id",
        F.col("attrs.phase").alias("phase"),
        F.col("attrs.route").alias("route"),
        F.col("attrs.method").alias("method"),
    ).filter(F.col("req_id").isNotNull() & F.col("phase").isin("start", "end"))
    moments = requests.groupBy("service", "req_id", "ts").agg(
        F.max(F.col("phase") == "end").alias("ends"),
        F.max(
            F.when(F.col("phase") == "start", F.struct("ts", "id", "route", "method"))
        ).alias("start"),
    )
    slot = F.floor(F.unix_micros("ts") / gap)
    own = F.floor(F.unix_micros("ts") / gap) == F.col("slot")
    slotted = moments.withColumn(
        "slot",
        F.explode(
            F.when(F.col("start").isNotNull(), F.array(slot, slot + 1)).otherwise(F.array(slot))
        ),
    ).withColumn("ends", F.col("ends") & own)
    until_now = (
        Window.partitionBy("service", "req_id", "slot")
        .orderBy("ts")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    paired = slotted.withColumn("s", F.last("start", ignorenulls=True).over(until_now))
    micros = F.unix_micros("ts") - F.unix_micros("s.ts")
    return paired.filter(F.col("ends") & (micros < gap)).select(
        "service",
        "req_id",
        "ts",
        (micros / 1000.0).alias("gap_ms"),
        F.col("s.route").alias("route"),
        F.col("s.method").alias("method"),
    )


def _own_duration() -> Column:
    """Infinite and undefined durations count as none: no later step could rank them."""
    own = F.col("attrs.duration_ms")
    return F.when((own >= 0) & (own < float("inf")), own)


def resolve(logs: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per log line with duration, route, method, status and phase settled.

    The line's own values come first, then those of its pair. Only lines that end a request
    take part in the join; all others (with no request id, a single hot NULL key) pass by.
    """
    ending = F.coalesce(
        (F.col("attrs.phase") == "end") & F.col("attrs.req_id").isNotNull(), F.lit(False)
    )
    facts = logs.select(
        "ts",
        "host",
        "service",
        "severity",
        ending.alias("_ending"),
        F.col("attrs.req_id").alias("req_id"),
        _own_duration().alias("dur"),
        F.col("attrs.route").alias("route"),
        F.col("attrs.method").alias("method"),
        F.when(F.col("attrs.status").between(100, 999), F.col("attrs.status")).alias("status"),
        F.col("attrs.phase").alias("phase"),
    )
    columns = ["ts", "host", "service", "severity", "dur", "route", "method", "status", "phase"]
    found = pairs.select(
        "service", "req_id", "ts", "gap_ms",
        F.col("route").alias("_route"), F.col("method").alias("_method"),
    )
    joined = facts.filter("_ending").join(found, ["service", "req_id", "ts"], "left")
    ended = joined.withColumns(
        {
            "dur": F.coalesce("dur", "gap_ms"),
            "route": F.coalesce("route", "_route"),
            "method": F.coalesce("method", "_method"),
        }
    )
    return ended.select(*columns).unionByName(facts.filter(~F.col("_ending")).select(*columns))


def resolve_requests(logs: DataFrame, max_gap_seconds: int = MAX_GAP_SECONDS) -> DataFrame:
    return resolve(logs, pair_requests(logs, max_gap_seconds))
