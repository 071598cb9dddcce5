"""What is kept for how long: partition expiry, row pruning, pressure plan, audit."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions.timing import instant, utc, utc_day
from tidelog.sources import tables

Moment = datetime | str

# -- fixed values: days kept ------------------------------------------------------------------
KEEP_DAYS = {
    "log_entries": 0,  # chosen by the operator; 0 keeps everything
    "metrics": 30,
    "host_metrics": 90,
    "log_rollup": 90,
    "endpoint_rollup": 30,
    "latency_sketch": 90,
    "error_groups": 90,
    "error_group_bucket": 30,
    "db_metrics": 30,
    "alert_events": 90,
    "maintenance_log": 90,
}
TIME_COLUMN = {
    "log_rollup": "bucket",
    "endpoint_rollup": "bucket",
    "latency_sketch": "bucket",
    "error_group_bucket": "bucket",
    "error_groups": "last_seen",
}
# Below this share of free disk (%): drop one day, drop two, stop collecting.
TRIM_BELOW, HARD_BELOW, STOP_BELOW = 15, 10, 8
ACTIONS = [
    "drop_partition", "emergency_drop", "paused", "resumed", "purge", "rewind",
    "collector_restart",
]


def expired_days(days: list[date], keep: int | None, as_of: Moment) -> list[date]:
    """Days older than `keep` days before the day of `as_of`; 0 or None keeps all."""
    if not keep or keep < 0:
        return []
    edge = utc_day(as_of) - timedelta(days=keep)
    return [d for d in days if d < edge]


def expire_partitions(
    spark: SparkSession, path: str, table: str, as_of: Moment, keep: int | None = None
) -> DataFrame:
    """Drop expired day partitions; returns the audit rows. No data is read or rewritten."""
    keep = KEEP_DAYS.get(table, 0) if keep is None else keep
    gone = expired_days(tables.list_days(spark, path), keep, as_of)
    if gone and table == "error_group_bucket":
        tables.close_days(spark, path, max(gone))
    tables.drop_days(spark, path, gone)
    return audit_rows(spark, as_of, [("drop_partition", f"{table} {d.isoformat()}") for d in gone])


def prune_rows(df: DataFrame, table: str, as_of: Moment, keep: int | None = None) -> DataFrame:
    """The rows of an unpartitioned table that are young enough to stay."""
    keep = KEEP_DAYS[table] if keep is None else keep
    if not keep:
        return df
    edge = instant(utc(as_of) - timedelta(days=keep))
    return df.filter(F.col(TIME_COLUMN.get(table, "ts")) >= edge)


def pressure_plan(partitions: DataFrame, free: DataFrame) -> DataFrame:
    """What low disk asks for, per host: (host, free_pct, action, tbl, day).

    partitions: host, tbl, day. free: host, free_pct. `paused` comes as one row without a
    table; at that point nothing is dropped any more.
    """
    pct = F.col("free_pct")
    tight = free.withColumn(
        "drops",
        F.when(pct < STOP_BELOW, 0).when(pct < HARD_BELOW, 2).when(pct < TRIM_BELOW, 1).otherwise(0),
    )
    oldest = Window.partitionBy("host", "tbl").orderBy("day")
    ranked = partitions.withColumn("n", F.row_number().over(oldest)).filter(F.col("n") <= 2)
    drops = (
        ranked.join(tight.filter(F.col("drops") > 0), "host")
        .filter(F.col("n") <= F.col("drops"))
        .select("host", "free_pct", F.lit("emergency_drop").alias("action"), "tbl", "day")
    )
    stops = free.filter(pct < STOP_BELOW).select(
        "host",
        "free_pct",
        F.lit("paused").alias("action"),
        F.lit(None).cast("string").alias("tbl"),
        F.lit(None).cast("date").alias("day"),
    )
    return drops.unionByName(stops)


def audit_rows(spark: SparkSession, as_of: Moment, entries: list[tuple[str, str]]) -> DataFrame:
    unknown = {action for action, _ in entries} - set(ACTIONS)
    if unknown:
        raise ValueError(f"unknown maintenance action: {sorted(unknown)}")
    rows = [(utc(as_of), action, detail) for action, detail in entries]
    return spark.createDataFrame(rows, "ts timestamp, action string, detail string")


def append_audit(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)


def purge(spark: SparkSession, path: str, table: str, condition: Column) -> None:
    """Remove the rows of a day-partitioned table that meet `condition`.

    Only days that hold such rows are rewritten; days that lose every row are dropped.
    """
    df = tables.read_table(spark, path, table)
    hit = F.coalesce(condition, F.lit(False))
    per_day = df.groupBy("day").agg(
        F.count("*").alias("n"), F.count_if(hit).alias("hits")
    ).filter(F.col("hits") > 0)
    touched = per_day.orderBy("day").collect()  # at most one row per stored day
    partly = [r["day"] for r in touched if r["hits"] < r["n"]]
    if partly:
        tables.overwrite_days(df.filter(F.col("day").isin(partly) & ~hit), path)
    tables.drop_days(spark, path, [r["day"] for r in touched if r["hits"] == r["n"]])


def missing_days(present: DataFrame, low: Moment, high: Moment) -> DataFrame:
    """Days of [low, high] without a partition, per table. present: tbl, day."""
    span = F.sequence(F.lit(utc_day(low)), F.lit(utc_day(high)))
    expected = present.select("tbl").distinct().select("tbl", F.explode(span).alias("day"))
    return expected.join(present.select("tbl", "day").distinct(), ["tbl", "day"], "left_anti")
