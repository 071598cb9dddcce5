"""Streams over log sources.

Ingest and rollups run in `foreachBatch`: new rows are appended, then every bucket they
touch is rebuilt from the stored logs. Late rows are never dropped, exact quantiles stay
exact, and a stream gives the same tables as a batch over the same files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from tidelog.functions import text as X
from tidelog.operators import pairing, parse
from tidelog.plans import jobs
from tidelog.plans.store import Store
from tidelog.sources import files, ingest, tables

# A batch is started at least this often, as a collector flushes.
TRIGGER = "5 seconds"


def _trigger(writer: DataStreamWriter, every: str | None) -> DataStreamWriter:
    if every is None:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=every)


def assembled(lines: DataFrame) -> DataFrame:
    """Multi-line records of `read_lines` rows. The file's modification time stands in for
    the time a line without a time stamp was seen: it is the same when a batch is replayed."""
    records = files.assemble_records(files.number_lines(lines), carry=("modified",))
    return records.withColumnRenamed("modified", "timestamp")


def ingest_stream(
    raw: DataFrame,
    store: Store,
    checkpoint: str,
    host: str | None,
    multiline: bool = False,
    selected: DataFrame | None = None,
    name_map: DataFrame | None = None,
    source_tz: str = "UTC",
    rollups: bool = True,
    every: str | None = TRIGGER,
    max_gap_seconds: int = pairing.MAX_GAP_SECONDS,
    after_batch: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Raw lines or events to `log_entries`, rollups and error groups.

    `host=None` takes the host of each line from `raw`. Lines of `growing.follow_lines` are records
    already if it was asked for them: `multiline` stays off here.
    `every=None` handles what is there and stops. `after_batch` gets the batch number when a
    batch is stored (to evaluate alerts, for example). A replayed batch finds its rows
    already stored and appends nothing.
    """

    def handle(batch: DataFrame, number: int) -> None:
        rows = assembled(batch) if multiline else batch
        if "modified" in rows.columns and "timestamp" not in rows.columns:
            rows = rows.withColumnRenamed("modified", "timestamp")
        parsed = parse.parse_logs(
            rows, name_map=name_map, source_tz=source_tz, host=host, origin=ingest.origin(rows)
        )
        if selected is not None:
            parsed = parse.only_selected(parsed, selected)
        rows = ingest.to_log_rows(parsed)
        seen = tables.ingest_rows(store.spark, rows, store.path("log_entries"))
        if seen is not None and rollups:
            # All rows of the batch, not only the newly stored: a batch that failed after the
            # append is replayed, and its buckets still have to be rebuilt.
            jobs.recompute(store, jobs.touched_buckets(seen, max_gap_seconds), max_gap_seconds)
        if after_batch is not None:
            after_batch(number)

    writer = raw.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start()


def append_stream(
    rows: DataFrame, path: str, checkpoint: str, every: str | None = TRIGGER
) -> StreamingQuery:
    """`log_entries` rows straight to the day table; the rollups are then a batch job.

    No watermark, so no row is too late. A batch that comes again, or lines delivered again by
    another file, are found in the ledger of `tables.ingest_rows` and add nothing.
    """

    def handle(batch: DataFrame, number: int) -> None:
        tables.ingest_rows(batch.sparkSession, batch, path)

    writer = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start()


@contextmanager
def state_partitions(spark: SparkSession, count: int | None = None) -> Iterator[None]:
    """Streams first started inside keep their state in `count` partitions, by default one a core.

    Every batch commits every store of every partition, changed or not, each as a file in the shared
    checkpoint: seven stores a partition in `paired_stream`. So their number follows the machines, not
    the partitions that batch shuffles are cut into. It stays what it is for the life of a checkpoint;
    name a `count` where a stream is to grow onto more cores later.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(count or min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def live_counts(rows: DataFrame, watermark: str = "15 minutes", width: str = "5 minutes") -> DataFrame:
    """Lines, errors and warnings per bucket, host and service as they arrive.

    Counts only, for a live view: quantiles and pairing need whole buckets (`ingest_stream`).
    Rows later than the watermark are missing here, not in the stored rollups.
    """
    return (
        rows.withWatermark("ts", watermark)
        .groupBy(F.window("ts", width).alias("w"), "host", "service")
        .agg(
            F.count("*").alias("total"),
            F.count_if(X.is_error(F.col("severity"))).alias("errors"),
            F.count_if(F.col("severity") == "WARN").alias("warns"),
        )
        .select(F.col("w.start").alias("bucket"), "host", "service", "total", "errors", "warns")
    )


def paired_stream(
    logs: DataFrame,
    max_gap_seconds: int = pairing.MAX_GAP_SECONDS,
    watermark: str = "10 minutes",
    unpaired: bool = False,
) -> DataFrame:
    """`pairing.pair_requests` of a stream: an end line leaves once no start can come for it any more.

    Starts and ends are reduced to distinct moments, joined over the gap, and the latest start
    of each end is kept. State goes with the watermark, so it holds the gap and the watermark's
    delay, not the stream. `unpaired` also gives the ends without a start, `gap_ms` NULL. Lines
    later than the watermark are missing here, not in stored rollups; lines without a service or
    a request id take no part. A request id that is
    on many lines meets all starts of one gap at each end: what the batch form avoids. Start it
    within `state_partitions`.
    """
    requests = logs.select(
        "service",
        F.col("attrs.req_id").alias("req_id"),
        "ts",
        "id",
        F.col("attrs.phase").alias("phase"),
        F.col("attrs.route").alias("route"),
        F.col("attrs.method").alias("method"),
    ).filter(F.col("service").isNotNull() & F.col("req_id").isNotNull())
    requests = requests.withWatermark("ts", watermark)
    key = ["service", "req_id", "ts"]
    ends = requests.filter(F.col("phase") == "end").select(*key).dropDuplicates(key)
    starts = (
        requests.filter(F.col("phase") == "start")
        .groupBy(F.col("service").alias("_service"), F.col("req_id").alias("_req_id"), F.col("ts").alias("_ts"))
        .agg(F.max(F.struct("id", "route", "method")).alias("_line"))
    )
    gap = F.make_dt_interval(secs=F.lit(max_gap_seconds))
    near = (
        (F.col("service") == F.col("_service"))
        & (F.col("req_id") == F.col("_req_id"))
        & (F.col("_ts") <= F.col("ts"))
        & (F.col("_ts") > F.col("ts") - gap)
    )
    start = F.when(F.col("_ts").isNotNull(), F.struct(F.unix_micros("_ts").alias("at"), "_line"))
    joined = ends.join(starts, near, "left_outer").select(*key, start.alias("_start"))
    found = joined.groupBy(*key).agg(F.max("_start").alias("_start"))
    pairs = found.select(
        *key,
        ((F.unix_micros("ts") - F.col("_start.at")) / 1000.0).alias("gap_ms"),
        F.col("_start._line.route").alias("route"),
        F.col("_start._line.method").alias("method"),
    )
    return pairs if unpaired else pairs.filter(F.col("gap_ms").isNotNull())
