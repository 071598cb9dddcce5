"""Queries that go through stored tables: written, changed by a job, and read back.

Each run uses a new folder below the shared one.
"""

from __future__ import annotations

import glob
import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import retention
from tidelog.plans import jobs
from tidelog.plans.registry import query
from tidelog.plans.rollup_queries import PAIRS_SQL, ROLLUPS
from tidelog.plans.standins import AS_OF, PAIR_GAP, VIEWS, base, ctes, logs, view
from tidelog.plans.store import Store
from tidelog.session import shared_dir
from tidelog.sources import growing, ingest, tables
from tidelog.streaming.pipeline import append_stream, paired_stream, state_partitions


def _new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stores/{uuid.uuid4().hex}"


def _log_rows(frame: DataFrame) -> DataFrame:
    return ingest.to_log_rows(frame)


def _stored_logs(spark: SparkSession, sf_dir: str) -> Store:
    store = Store(spark, _new_folder(spark))
    tables.write_logs(_log_rows(logs(spark, sf_dir)), store.path("log_entries"))
    return store


# The whole job on disk: lines without the completions first, then all of them (the early ones
# once more); every bucket is built, then rebuilt with the late rows.
@query(
    ROLLUPS
    + """SELECT bucket, host, service, errors, warns, total, timed, req_errors, apdex_s, apdex_t,
                round(p95_ms, 6) AS p95_ms FROM log_rollup"""
)
def stored_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, _new_folder(spark))
    rows = _log_rows(logs(spark, sf_dir))
    early = rows.filter(F.coalesce(F.col("attrs.phase"), F.lit("")) != "end")
    for delivery in (early, rows):
        seen = tables.ingest_rows(spark, delivery, store.path("log_entries"))
        jobs.recompute(store, jobs.touched_buckets(seen, PAIR_GAP), PAIR_GAP)
    return store.read("log_rollup").select(
        "bucket", "host", "service", "errors", "warns", "total", "timed", "req_errors", "apdex_s",
        "apdex_t", F.round("p95_ms", 6).alias("p95_ms"),
    )


@query("SELECT DISTINCT CAST(ts AS DATE) AS day, true AS has_bytes FROM events")
def partition_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _stored_logs(spark, sf_dir)
    sizes = tables.partition_sizes(spark, store.path("log_entries"))
    return sizes.select("day", (F.col("bytes") > 0).alias("has_bytes"))


@query(
    """SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events
       WHERE CAST(ts AS DATE) >= DATE '2024-01-31' - 10 GROUP BY 1"""
)
def expired_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _stored_logs(spark, sf_dir)
    retention.expire_partitions(spark, store.path("log_entries"), "log_entries", AS_OF, keep=10)
    return store.read("log_entries").groupBy("day").agg(F.count("*").alias("n"))


@query(
    ctes("logs")
    + """SELECT service, severity, count(*) AS n FROM logs
         WHERE NOT (service = 'svc2' AND severity = 'ERROR') GROUP BY 1, 2"""
)
def purged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _stored_logs(spark, sf_dir)
    gone = (F.col("service") == "svc2") & (F.col("severity") == "ERROR")
    retention.purge(spark, store.path("log_entries"), "log_entries", gone)
    return store.read("log_entries").groupBy("service", "severity").agg(F.count("*").alias("n"))


# A stream over the events file, run twice from the start: the second delivery adds nothing.
@query(
    ctes("logs")
    + """SELECT CAST(ts AS DATE) AS day, host, service, count(*) AS n FROM logs GROUP BY 1, 2, 3"""
)
def streamed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _new_folder(spark)
    stream = (
        spark.readStream.schema(base(spark, sf_dir, "events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )
    select = VIEWS["logs"].replace("FROM events", "FROM {events}")
    lines = spark.sql(select, events=stream).select("ts", "host", "service", "kind", "severity", "body")
    for run in (1, 2):
        append_stream(_log_rows(lines), f"{folder}/rows", f"{folder}/progress{run}", every=None).awaitTermination()
    return spark.read.parquet(f"{folder}/rows").groupBy("day", "host", "service").agg(F.count("*").alias("n"))


# Lines without a time of their own, many of them equal, on three hosts and two files each: part
# of them first, then all, then all once more. Every line is stored as often as it was written.
@query(
    """SELECT concat('host', doc_id % 3) AS host, source AS service, count(*) AS n, count(*) AS n_ids,
              sum(length(replace(text, chr(13), ''))) AS chars
       FROM documents GROUP BY 1, 2"""
)
def redelivered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _new_folder(spark)
    events = base(spark, sf_dir, "documents").select(
        F.lit("2024-01-01 00:00:00").alias("ts"), F.concat(F.lit("host"), F.col("doc_id") % 3).alias("host"),
        F.col("source").alias("service"), F.col("text").alias("body"),
        F.concat(F.lit("/var/log/"), F.floor("doc_id") % 2, F.lit(".log")).alias("origin"), "doc_id",
    )
    for delivery in (events.filter(F.col("doc_id") % 4 == 0), events, events):
        tables.ingest_rows(spark, _log_rows(delivery.drop("doc_id")), f"{folder}/log_entries")
    rows = tables.read_table(spark, f"{folder}/log_entries", "log_entries")
    return rows.groupBy("host", "service").agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"), F.sum(F.length("body")).alias("chars")
    )


def _append(parts):
    """Writes lines behind what their files hold; a retried task writes the same again."""
    ends: dict[str, int] = {}
    for part in parts:
        for path, rows in part.groupby("path", sort=False):
            text = "".join(f"{line}\n" for line in rows["line"]).encode()
            with open(path, "r+b") as file:
                file.seek(ends.setdefault(path, int(rows["size"].iloc[0])))
                ends[path] += file.write(text)
        yield pd.DataFrame({"n": [len(part)]})


# Files of each service, followed while they grow: one run on two thirds of the lines, then the
# rest is appended and every second file renamed, then a run that finds nothing new. Every fifth
# line has a trace of two more lines; the last record of a file stays open until the last run.
@query(
    ctes("raw_lines")
    + """SELECT regexp_extract(file, '(svc\\d)', 1) AS service, count(*) AS n, count(DISTINCT id) AS n_ids,
                sum(length(CAST(id AS VARCHAR)) + 1 + length(message) + CASE WHEN id % 5 = 0 THEN 26 ELSE 0 END) AS chars
         FROM raw_lines GROUP BY 1"""
)
def followed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _new_folder(spark).removeprefix("file:")
    trace = F.when(F.col("id") % 5 == 0, F.lit("\n   at one.js\n   at two.js")).otherwise(F.lit(""))
    lines = view(spark, sf_dir, "raw_lines").select(
        "id", F.regexp_extract("file", r"(svc\d)", 1).alias("service"), F.concat_ws(" ", "id", F.concat("message", trace)).alias("line")
    )
    lines.filter("id % 3 > 0").select("service", "line").write.partitionBy("service").text(f"{folder}/in")

    def follow(**options) -> None:
        raw = growing.follow_lines(spark, f"{folder}/in/*/*.txt*", multiline=True, **options)
        writer = raw.writeStream.option("checkpointLocation", f"{folder}/progress")
        writer.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()

    follow()
    # One name a task and service: the list of files, not their lines.
    paths = sorted(glob.glob(f"{folder}/in/*/*.txt"))
    files = spark.createDataFrame([(p, os.path.getsize(p), p.split("service=")[1][:4]) for p in paths], "path string, size long, service string")
    files = files.groupBy("service").agg(F.collect_list(F.struct("path", "size")).alias("files"))
    rest = lines.filter("id % 3 = 0")
    unseen = rest.join(files, "service", "left_anti").select("service", "line")
    rest = rest.join(files, "service")
    rest = rest.select("line", F.get("files", F.pmod(F.hash("id"), F.size("files"))).alias("file"))
    rest = rest.select("file.path", "file.size", "line").repartition("path")
    rest.mapInPandas(_append, "n long").agg(F.sum("n")).collect()
    for path in paths[::2]:
        os.rename(path, f"{path}.1")
    unseen.write.mode("append").partitionBy("service").text(f"{folder}/in")
    follow()
    follow(progress=f"{folder}/ended", idle_seconds=0)
    found = spark.read.schema("message string, file string").parquet(f"{folder}/out")
    return found.groupBy(F.regexp_extract("file", r"(svc\d)", 1).alias("service")).agg(
        F.count("*").alias("n"), F.countDistinct(F.regexp_extract("message", r"^\d+", 0)).alias("n_ids"), F.sum(F.length("message")).alias("chars")
    )


# Lines in three deliveries: the earlier half without half of its last five hours, the rest, and
# one line of a day later, after which every end has left the stream.
@query(ctes("logs", pairs=PAIRS_SQL) + "SELECT * FROM pairs")
def streamed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _new_folder(spark)
    rows = logs(spark, sf_dir)
    low, high = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    middle, at = F.lit(((low or 0) + (high or 0)) // 2), F.unix_micros("ts")
    held = F.coalesce((at >= middle) | ((at >= middle - PAIR_GAP * 1_000_000) & (F.col("id") % 2 == 0)), F.lit(True))
    late = F.timestamp_micros(F.lit((high or 0) + 86_400_000_000))
    given = {"req_id": F.lit("closing"), "phase": F.lit("end")}
    facts = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema["attrs"].dataType]
    last = spark.range(1).select("id", late.alias("ts"), F.lit("closing").alias("service"), F.struct(*facts).alias("attrs"))
    columns = ["id", "ts", "service", "attrs"]
    for delivery in (rows.filter(~held), rows.filter(held), last):
        delivery.select(*columns).write.mode("append").parquet(f"{folder}/in")
        lines = spark.readStream.schema(rows.select(*columns).schema).parquet(f"{folder}/in")
        writer = paired_stream(lines, PAIR_GAP, "6 hours").writeStream.option("checkpointLocation", f"{folder}/progress")
        with state_partitions(spark):
            found = writer.trigger(availableNow=True).start(f"{folder}/out")
        found.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


# Twelve small deliveries, then few files a day.
@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, true AS few_files FROM events GROUP BY 1")
def compacted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, _new_folder(spark))
    path = store.path("log_entries")
    for part in range(12):
        tables.write_logs(_log_rows(logs(spark, sf_dir).filter(F.col("id") % 12 == part)), path)
    jobs.run_compaction(store)
    sizes = tables.partition_sizes(spark, path)
    few = F.col("files") <= F.greatest(F.lit(8), 8 * F.ceil(F.col("bytes") / tables.FILE_BYTES))
    rows = store.read("log_entries").groupBy("day").agg(F.count("*").alias("n"))
    return rows.join(sizes.select("day", few.alias("few_files")), "day")


# Everything is counted, the counts of the older days are dropped, everything is counted again.
@query(ctes("logs") + "SELECT service, count(*) AS occurrences FROM logs WHERE severity = 'ERROR' GROUP BY 1")
def closed_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _stored_logs(spark, sf_dir)
    buckets = jobs.touched_buckets(store.read("log_entries"), 0)
    jobs.recompute(store, buckets, PAIR_GAP)
    counts = "error_group_bucket"
    retention.expire_partitions(spark, store.path(counts), counts, AS_OF, keep=10)
    jobs.recompute(store, buckets, PAIR_GAP)
    return store.read("error_groups").groupBy("service").agg(F.sum("occurrences").alias("occurrences"))
