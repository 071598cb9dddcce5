"""Listing queries over the stored tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import patterns as P
from tidelog.functions import text as X
from tidelog.functions.timing import instant, recent, utc_day
from tidelog.operators.metrics import health

Moment = datetime | str
PAGE_ROWS = 200


def page(
    logs: DataFrame, before_ts: Moment | None = None, before_id: int | None = None,
    limit: int = PAGE_ROWS,
) -> DataFrame:
    """The next page going back in time, continuing strictly before (ts, id)."""
    if before_ts is not None:
        edge = instant(before_ts)
        at_edge = (F.col("ts") == edge) & (F.col("id") < F.lit(before_id))
        logs = logs.filter((F.col("ts") <= edge) & ((F.col("ts") < edge) | at_edge))
        if "day" in logs.columns:
            logs = logs.filter(F.col("day") <= F.lit(utc_day(before_ts)))
    return logs.orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def volume(logs: DataFrame, as_of: Moment, seconds: int = 3600) -> DataFrame:
    """Rows per service and kind, busiest first."""
    return (
        recent(logs, as_of, seconds)
        .groupBy("service", "kind")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "service", "kind")
    )


def body_matches(term: str, how: str) -> Column:
    body = F.col("body")
    if how == "like":
        return body.like(term)
    if how == "ilike":
        return body.ilike(term)
    if how == "regex":
        return body.rlike(term)
    raise ValueError(f"unknown search {how!r}")


def search(logs: DataFrame, term: str, how: str = "ilike", limit: int = 50) -> DataFrame:
    """The newest rows whose body matches."""
    return logs.filter(body_matches(term, how)).orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def secret_audit(logs: DataFrame, limit: int = 20) -> DataFrame:
    """The newest rows that still mention a secret after redaction."""
    return search(logs, P.SECRET_WORDS, "regex", limit)


def rows_per_day(logs: DataFrame) -> DataFrame:
    day = F.col("day") if "day" in logs.columns else F.to_date("ts")
    return logs.groupBy(day.alias("day")).agg(
        F.count("*").alias("n"), F.min("ts").alias("oldest"), F.max("ts").alias("newest")
    )


def store_stats(
    logs: DataFrame, state: DataFrame, rules: DataFrame, groups: DataFrame
) -> DataFrame:
    """One row: size and extent of the log store, firing alerts, enabled rules, open groups.

    Every table is aggregated on its own; the one-row results are stacked and folded.
    """

    def one(df: DataFrame, **columns: Column) -> DataFrame:
        return df.agg(*[c.alias(n) for n, c in columns.items()])

    parts = [
        one(logs, n_rows=F.count("*"), oldest=F.min("ts"), newest=F.max("ts")),
        one(state, firing=F.count_if(F.col("state") == "firing")),
        one(rules, enabled_rules=F.count_if(F.coalesce("enabled", F.lit(False)))),
        one(groups, open_groups=F.count_if(F.col("state") == "open")),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def maintenance_summary(log: DataFrame, present: DataFrame, recent_rows: int = 5) -> DataFrame:
    """Last cleanup, last day with a partition, and the newest maintenance entries.

    present: day of each partition of the log table.
    """
    entry = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "action", F.coalesce("detail", F.lit("")))
    cleanup = log.agg(F.max(F.when(F.col("action") == "drop_partition", F.col("ts"))).alias("last_cleanup"))
    through = present.agg(F.max("day").alias("partitions_through"))
    newest = (
        log.orderBy(F.desc("ts"), "action", "detail")
        .limit(recent_rows)
        .select(F.struct(F.col("ts"), entry.alias("entry")).alias("e"))
        .agg(F.sort_array(F.collect_list("e"), asc=False).alias("es"))
        .select(F.transform("es", lambda e: e["entry"]).alias("recent"))
    )
    stacked = cleanup.unionByName(through, allowMissingColumns=True).unionByName(
        newest, allowMissingColumns=True
    )
    return stacked.agg(
        F.max("last_cleanup").alias("last_cleanup"),
        F.max("partitions_through").alias("partitions_through"),
        F.max("recent").alias("recent"),
    )


def discovered(
    processes: DataFrame, containers: DataFrame, selected: DataFrame, own: str = ""
) -> DataFrame:
    """Everything that could be collected, with its state and whether it is selected.

    processes: service, status, restarts. containers: service, status_text.
    """
    from_processes = processes.select(
        "service", F.lit("pm2").alias("kind"), "status", F.col("restarts").cast("int").alias("restarts")
    )
    state = F.when(health(F.col("status_text")) == "unhealthy", F.lit("unhealthy")).otherwise(
        F.lit("running")
    )
    from_containers = containers.filter(F.col("service") != own).select(
        "service", F.lit("docker").alias("kind"), state.alias("status"),
        F.lit(None).cast("int").alias("restarts"),
    )
    chosen = selected.select("service").distinct().withColumn("_chosen", F.lit(True))
    return (
        from_processes.unionByName(from_containers)
        .join(chosen, "service", "left")
        .withColumn("enabled", F.coalesce("_chosen", F.lit(False)))
        .drop("_chosen")
    )


def tail_stream(
    lines: DataFrame,
    filters: list[str] | None = None,
    live: DataFrame | None = None,
) -> DataFrame:
    """(service, message) of lines worth watching live, from a stream or a batch.

    lines: service, message, and file where there is one. Archives are skipped, the selection
    of stored services does not matter, `filters` are parts of service names, and with a list
    of live processes only theirs are shown.
    """
    from tidelog.operators.parse import small_side

    out = lines.filter(F.col("message") != "")
    if "file" in lines.columns:
        out = out.filter(~F.coalesce(X.is_rotated(F.col("file")), F.lit(False)))
    if filters:
        out = out.filter(X.any_contains(F.col("service"), filters))
    if live is not None and not live.isEmpty():
        out = out.join(small_side(live.select("service").distinct()), "service", "left_semi")
    return out.select("service", "message")


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row; the form for results of any size."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def json_array(df: DataFrame, limit: int) -> DataFrame:
    """A listing as one JSON array (`[]` when empty), for the top-n listings only: `limit` is
    the n of the listing, which `df` must already be ordered by."""
    packed = F.coalesce(
        F.to_json(F.collect_list(F.struct(*df.columns)), {"ignoreNullFields": "false"}), F.lit("[]")
    )
    return df.limit(limit).agg(packed.alias("json"))
