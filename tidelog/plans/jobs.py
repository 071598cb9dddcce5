"""The scheduled jobs: rollups and error groups, alerts, retention. Each is one call."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.timing import BUCKET_SECONDS, align, align_up, bucket, time_range, utc
from tidelog.operators import alerts, errors, pairing, retention, rollup
from tidelog.plans.store import APPENDED, DAY_TABLES, Store
from tidelog.session import cut_lineage
from tidelog.sources import tables

Moment = datetime | str
TRAILING_SECONDS = 900


def bucket_list(low: Moment, high: Moment) -> list[datetime]:
    """Starts of all buckets that touch [low, high); at most 288 for a day."""
    at, end = align(low), align_up(high)
    out = []
    while at < end:
        out.append(at)
        at += timedelta(seconds=BUCKET_SECONDS)
    return out


def touched_buckets(rows: DataFrame, max_gap_seconds: int = pairing.MAX_GAP_SECONDS) -> DataFrame:
    """Buckets (column bucket) whose rollups change when `rows` are added.

    A line changes its own bucket. A start line can also give a duration to an end line up to
    the maximum gap later.
    """
    later = F.when(F.col("attrs.phase") == "start", F.lit(_buckets_of(max_gap_seconds))).otherwise(F.lit(0))
    # Few buckets first: a row of each start line for every bucket of a long gap would be many.
    own = rows.select(bucket(F.col("ts")).alias("own"), later.alias("later")).distinct()
    return own.select(F.explode(_steps(F.col("own"), F.lit(0), F.col("later"))).alias("bucket")).distinct()


def _buckets_of(seconds: int) -> int:
    return -(-seconds // BUCKET_SECONDS)


def _steps(at: Column, first: Column, last: Column) -> Column:
    """Bucket starts from `first` to `last` buckets after `at`."""
    return F.transform(
        F.sequence(first, last), lambda i: F.timestamp_seconds(F.unix_seconds(at) + i.cast("bigint") * BUCKET_SECONDS)
    )


def _rows_of(logs: DataFrame, buckets: DataFrame) -> DataFrame:
    """Log rows of the given buckets. The buckets prune the days of the scan while it runs
    (288 narrow rows a day at most are broadcast); other days are not read."""
    wanted = tables.with_days(buckets).withColumnRenamed("bucket", "_bucket")
    rows = logs.withColumn("_bucket", bucket(F.col("ts")))
    return rows.join(F.broadcast(wanted), ["day", "_bucket"], "left_semi").drop("_bucket")


def recompute(
    store: Store,
    buckets: DataFrame | Iterable[datetime],
    max_gap_seconds: int = pairing.MAX_GAP_SECONDS,
) -> None:
    """Rebuild rollups and error counts of whole buckets from the stored logs.

    Everything is computed from all rows of a bucket, never added to what was there, so late
    rows are included and running it again changes nothing. The rollups and the sketches come
    out of one derivation. Buckets of a frame (column bucket) stay on the executors; a list
    stands for a range of time known beforehand, which also prunes inside a day.
    """
    logs = store.read("log_entries")
    ahead = _buckets_of(max_gap_seconds)
    if isinstance(buckets, DataFrame):
        chosen = cut_lineage(buckets.select("bucket").distinct())
    else:
        starts = sorted(set(buckets))
        if not starts:
            return
        chosen = store.spark.createDataFrame([(b,) for b in starts], "bucket timestamp")
        low, high = starts[0], starts[-1] + timedelta(seconds=BUCKET_SECONDS)
        logs = time_range(logs, low - timedelta(seconds=BUCKET_SECONDS * ahead), high)
    # Only what is rebuilt, and what may pair with it.
    around = chosen.select(F.explode(_steps(F.col("bucket"), F.lit(-ahead), F.lit(0))).alias("bucket")).distinct()
    inside = _rows_of(logs, chosen)
    pairs = pairing.pair_requests(_rows_of(logs, around), max_gap_seconds)
    # The error tables share no rows with the rollups, so their jobs fill what those leave idle.
    with ThreadPoolExecutor(1) as beside:
        counted = beside.submit(inheritable_thread_target(store.spark)(_recompute_errors), store, inside, chosen)
        # Not persisted: Spark does not see that two scans of a cached frame are the same, and each
        # rollup would group and shuffle its rows twice.
        resolved = cut_lineage(pairing.resolve(inside, pairs))
        for table, build in (
            ("log_rollup", rollup.service_rollup),
            ("endpoint_rollup", rollup.endpoint_rollup),
            ("latency_sketch", rollup.latency_sketches),
        ):
            tables.replace_buckets(store.spark, store.path(table), table, build(resolved), chosen)
        counted.result()


def _recompute_errors(store: Store, inside: DataFrame, chosen: DataFrame) -> None:
    """Counts per bucket are replaced; a group's lifetime count moves by the difference.

    Only a fingerprint that occurs more often than already counted is a recurrence, so
    recomputing the same rows neither adds to a group nor reopens a resolved one. The new
    groups are staged before and published after the buckets are replaced. Days whose bucket
    counts retention has dropped are closed: what was counted there is not known any more, so
    their buckets add nothing, in particular not once more.
    """
    closed = tables.closed_through(store.spark, store.path("error_group_bucket"))
    if closed is not None:
        inside = inside.filter(F.to_date("ts") > F.lit(closed))
        chosen = chosen.filter(F.to_date("bucket") > F.lit(closed))
    rows = cut_lineage(errors.error_rows(inside))  # fingerprints are taken once
    new_counts = cut_lineage(errors.group_buckets(rows))
    wanted = F.broadcast(tables.with_days(chosen))
    counted = store.read("error_group_bucket").join(wanted, ["day", "bucket"], "left_semi")
    change = new_counts.select("fp", "occurrences").unionByName(
        counted.select("fp", (-F.col("occurrences")).alias("occurrences"))
    )
    more = change.groupBy("fp").agg(F.sum("occurrences").alias("more")).filter(F.col("more") > 0)
    news = errors.group_stats(rows).join(more, "fp").withColumn("occurrences", F.col("more")).drop("more")
    merged = errors.merge_error_groups(store.read("error_groups"), news)
    staged = tables.stage_version(merged, store.path("error_groups"))
    tables.replace_buckets(
        store.spark, store.path("error_group_bucket"), "error_group_bucket", new_counts, chosen
    )
    tables.publish_version(store.spark, store.path("error_groups"), staged)


def run_rollup(
    store: Store,
    as_of: Moment,
    backfill_days: int = 0,
    max_gap_seconds: int = pairing.MAX_GAP_SECONDS,
) -> None:
    """The last 15 minutes (or days), widened to whole buckets."""
    back = timedelta(days=backfill_days) if backfill_days else timedelta(seconds=TRAILING_SECONDS)
    high = utc(as_of) + timedelta(minutes=1)
    recompute(store, bucket_list(utc(as_of) - back, high), max_gap_seconds)


_CONDITION_TABLES = [
    "log_entries", "error_groups", "metrics", "host_metrics", "log_rollup", "endpoint_rollup",
    "cert_expiry",
]


def run_alerts(store: Store, as_of: Moment, host: str = "unknown") -> alerts.Evaluation:
    """Evaluate all rules, keep the new state, append the events of this run.

    The result of each condition is written once and used for state and events, so both speak of
    the same moment even while logs keep arriving. A condition that fails, when it is planned or
    while it runs, leaves the state of its own rules alone.
    """
    rules = store.read("alert_rules")
    done = alerts.evaluate(rules, {t: store.read(t) for t in _CONDITION_TABLES}, as_of, stage=cut_lineage)
    state, events = alerts.transitions(
        store.read("alert_state"), done.firing, rules, as_of, done.evaluated, host
    )
    columns = ["ts", "rule_id", "service", "host", "value", "state"]
    kept = events.select(F.xxhash64("rule_id", "service", "ts", "state").alias("id"), *columns)
    store.append("alert_events", kept)
    store.replace("alert_state", state)
    return done


def run_compaction(store: Store, most_files: int = 8, before: Moment | None = None) -> dict[str, list]:
    """Few files instead of many for the days of all day tables; returns the days by table.

    `before` leaves younger days alone, which still get rows.
    """
    edge = utc(before).date() if before is not None else None
    return {
        table: tables.compact_days(store.spark, store.path(table), table, most_files, edge)
        for table in DAY_TABLES
    }


def run_retention(store: Store, as_of: Moment, log_days: int | None = None) -> DataFrame:
    """Drop expired days, prune the other tables, record what was dropped."""
    entries = None
    for table in DAY_TABLES:
        keep = log_days if table == "log_entries" else None
        dropped = retention.expire_partitions(
            store.spark, store.path(table), table, as_of,
            (keep or 0) if table == "log_entries" else None,
        )
        entries = dropped if entries is None else entries.unionByName(dropped)
    tables.expire_ledger(store.spark, store.path("log_entries"))
    if tables.current_version(store.spark, store.path("error_groups")):
        groups = retention.prune_rows(store.read("error_groups"), "error_groups", as_of)
        store.replace("error_groups", groups)
    for table in APPENDED:
        if tables.exists(store.spark, store.path(table)):
            kept = cut_lineage(retention.prune_rows(store.read(table), table, as_of))
            kept.write.mode("overwrite").parquet(store.path(table))
    store.append("maintenance_log", entries)
    return entries
