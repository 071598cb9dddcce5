"""Why is something missing? Diagnostic queries over logs, rollups, files and read positions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import patterns as P
from tidelog.functions import text as X
from tidelog.functions.quantiles import grouped_quantiles
from tidelog.functions.timing import instant, recent, time_range

Moment = datetime | str
HOUR = 3600

# -- fixed values: limits of the checks (seconds, except lag in minutes) ------------------------
SILENT_AFTER = 3600
LIVE_WITHIN = 600
JUST_RESTARTED = 180
SETTLED_AFTER = 300
WRITTEN_WITHIN = 120
NO_ROWS_FOR = 900
LAG_MINUTES = 20


def metric_freshness(metrics: DataFrame, as_of: Moment, seconds: int = 600) -> DataFrame:
    """Samples and distinct services per kind of source in the last minutes."""

    def services(kind: str) -> Column:
        return F.count_distinct(F.when(F.col("kind") == kind, F.col("service")))

    return recent(metrics, as_of, seconds).agg(
        F.count("*").alias("samples"),
        services("pm2").alias("pm2_services"),
        services("docker").alias("docker_services"),
    )


def parser_yield(logs: DataFrame, as_of: Moment, seconds: int = HOUR) -> DataFrame:
    """How many rows carry each request fact."""

    def having(name: str) -> Column:
        return F.count(F.col(f"attrs.{name}")).alias(f"with_{name}")

    return recent(logs, as_of, seconds).agg(
        having("status"),
        having("method"),
        having("route"),
        F.count_if(F.col("attrs.phase") == "start").alias("starts"),
        F.count_if(F.col("attrs.phase") == "end").alias("ends"),
        having("req_id"),
    )


def rows_since(logs: DataFrame, since: Moment) -> DataFrame:
    return time_range(logs, since, open_low=True).agg(F.count("*").alias("n"))


def timed_share(logs: DataFrame, as_of: Moment, seconds: int = HOUR) -> DataFrame:
    """Lines, and lines that carry a duration."""
    return recent(logs, as_of, seconds).agg(
        F.count("*").alias("n_lines"), F.count("attrs.duration_ms").alias("timed")
    )


def raw_latency(logs: DataFrame, as_of: Moment, seconds: int = HOUR) -> DataFrame:
    """Exact p50 and p95 of the logged durations per service."""
    rows = recent(logs, as_of, seconds).select(
        "service", F.when(F.col("attrs.duration_ms") >= 0, F.col("attrs.duration_ms")).alias("d")
    )
    return grouped_quantiles(
        rows.filter(F.col("d").isNotNull()), ["service"], "d",
        {"p50_ms": 0.50, "p95_ms": 0.95}, counted="timed",
    )


def timing_fields(logs: DataFrame, as_of: Moment, seconds: int = HOUR, limit: int = 20) -> DataFrame:
    """Fields in the text that look like durations (name and number), the first 20 by name."""
    rows = recent(logs, as_of, seconds)
    pairs = F.arrays_zip(
        F.regexp_extract_all("body", F.lit(P.TIMING_FIELD), F.lit(1)).alias("field"),
        F.regexp_extract_all("body", F.lit(P.TIMING_FIELD), F.lit(2)).alias("value"),
    )
    return (
        rows.select(F.explode(pairs).alias("m"))
        .select(F.col("m.field").alias("field"), F.col("m.value").alias("value"))
        .distinct()
        .orderBy("field", "value")
        .limit(limit)
    )


def request_records(
    logs: DataFrame, as_of: Moment, seconds: int = 6 * HOUR, limit: int = 2
) -> DataFrame:
    """The newest records that look like a request, in full."""
    likely = F.lit(False)
    for pattern in P.REQUEST_RECORD_LIKE:
        likely = likely | F.col("body").ilike(pattern)
    return recent(logs, as_of, seconds).filter(likely).orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def latency_explained(logs: DataFrame, as_of: Moment, seconds: int = HOUR) -> DataFrame:
    """Where each service's latency comes from, or why it has none."""
    counts = recent(logs, as_of, seconds).groupBy("service").agg(
        F.count("*").alias("n_lines"),
        F.count("attrs.duration_ms").alias("timed"),
        F.count_if(F.col("attrs.phase") == "end").alias("ended"),
        F.count_if(F.col("body").rlike(P.REQUEST_ID_WORD)).alias("with_id"),
    )
    source = (
        F.when(F.col("ended") > 0, F.lit("pairs"))
        .when(F.col("timed") > 0, F.lit("timed lines"))
        .when(F.col("with_id") > 0, F.lit("ids without start or end wording"))
        .otherwise(F.lit("none"))
    )
    return counts.withColumn("source", source).orderBy(F.desc("n_lines"), "service")


def newest_files(files: DataFrame) -> DataFrame:
    """The file of each service that was written last. files: service, path, size, mtime."""
    return (
        files.groupBy("service")
        .agg(F.max(F.struct("mtime", "path", "size")).alias("f"))
        .select("service", "f.mtime", "f.path", "f.size")
    )


def _age(column: str, as_of: Moment) -> Column:
    return F.unix_seconds(instant(as_of)) - F.unix_seconds(column)


def selected_activity(
    selected: DataFrame,
    logs: DataFrame,
    files: DataFrame,
    containers: DataFrame,
    as_of: Moment,
    collector_up_seconds: int | None = None,
) -> DataFrame:
    """Every selected service, stored rows of the last hour, newest file, and a verdict."""
    stored = recent(logs, as_of, HOUR).groupBy("service").agg(F.count("*").alias("n_rows"))
    running = containers.select("service").distinct().withColumn("container", F.lit(True))
    age = F.col("age")
    up = F.lit(collector_up_seconds if collector_up_seconds is not None else 99999)
    verdict = (
        F.when(
            F.col("mtime").isNotNull(),
            F.when(F.col("n_rows") > 0, F.lit("collected"))
            .when(age > SILENT_AFTER, F.lit("service is silent"))
            .when((age < LIVE_WITHIN) & (up < JUST_RESTARTED), F.lit("too early to judge"))
            .when(age < LIVE_WITHIN, F.lit("WRITTEN BUT NOT COLLECTED"))
            .otherwise(F.lit("no rows yet")),
        )
        .when(F.coalesce("container", F.lit(False)), F.lit("container"))
        .otherwise(F.lit("no log file"))
    )
    return (
        selected.select("service").distinct()
        .join(stored, "service", "left")
        .join(newest_files(files), "service", "left")
        .join(running, "service", "left")
        .withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
        .withColumn("age", _age("mtime", as_of))
        .select("service", "n_rows", "path", "size", F.col("age").alias("age_secs"), verdict.alias("verdict"))
    )


def with_positions(files: DataFrame, positions: DataFrame) -> DataFrame:
    """Files with the saved read position of their (host, device, inode), if any."""
    keys = [k for k in ("host", "device", "inode") if k in files.columns and k in positions.columns]
    return files.join(positions.select(*keys, "position"), keys, "left")


def file_verdicts(
    files: DataFrame, positions: DataFrame, selected: DataFrame, as_of: Moment
) -> DataFrame:
    """Of each file written in the last ten minutes: is it kept, and where is it being read?

    `size` NULL means the file could not be examined.
    """
    live = files.filter(_age("mtime", as_of) < LIVE_WITHIN)
    chosen = selected.select("service").distinct().withColumn("chosen", F.lit(True))
    verdict = (
        F.when(F.col("chosen").isNull(), F.lit("DROPPED"))
        .when(F.col("size").isNull(), F.lit("collected, file not readable"))
        .when(F.col("position").isNull(), F.lit("collected, no checkpoint yet"))
        .when(F.col("position") > F.col("size"), F.lit("STALLED"))
        .otherwise(F.lit("collected"))
    )
    return with_positions(live, positions).join(chosen, "service", "left").withColumn(
        "verdict", verdict
    ).drop("chosen")


def stalled_positions(files: DataFrame, positions: DataFrame, as_of: Moment) -> DataFrame:
    """Files being written whose saved position lies behind their end (a rotation reused them)."""
    live = files.filter(_age("mtime", as_of) <= LIVE_WITHIN)
    return with_positions(live, positions).filter(F.col("position") > F.col("size"))


def silent_while_writing(
    selected: DataFrame,
    logs: DataFrame,
    files: DataFrame,
    as_of: Moment,
    collector_up_seconds: int | None = None,
) -> DataFrame:
    """Selected services that write to their file and have stored nothing for 15 minutes.

    A collector up for less than five minutes is not judged.
    """
    settled = collector_up_seconds is None or collector_up_seconds >= SETTLED_AFTER
    active = recent(logs, as_of, NO_ROWS_FOR).select("service").distinct()
    return (
        selected.select("service").distinct().filter(F.lit(settled))
        .join(active, "service", "left_anti")
        .join(newest_files(files), "service")
        .withColumn("age_secs", _age("mtime", as_of))
        .filter(F.col("age_secs") < WRITTEN_WITHIN)
        .select("service", "path", "age_secs")
    )


def rollup_lag(logs: DataFrame, rollup: DataFrame) -> DataFrame:
    """One row: newest log row, newest bucket, minutes between, verdict."""
    newest = logs.agg(F.max("ts").alias("newest_row")).unionByName(
        rollup.agg(F.max("bucket").alias("newest_bucket")), allowMissingColumns=True
    )
    both = newest.agg(
        F.max("newest_row").alias("newest_row"), F.max("newest_bucket").alias("newest_bucket")
    )
    micros = F.unix_micros("newest_row") - F.unix_micros("newest_bucket")
    lag = F.round(micros / 60e6)
    verdict = (
        F.when(F.col("lag_minutes").isNull(), F.lit("never"))
        .when(F.col("lag_minutes") > LAG_MINUTES, F.lit("behind"))
        .otherwise(F.lit("current"))
    )
    return both.withColumn("lag_minutes", lag).withColumn("verdict", verdict)


def top_endpoints(
    rollup: DataFrame, as_of: Moment, seconds: int = HOUR, limit: int = 5
) -> DataFrame:
    """The most called endpoints with their error share and worst p95."""
    rows = recent(rollup, as_of, seconds, "bucket")
    return (
        rows.groupBy("method", "route")
        .agg(
            F.sum("calls").alias("calls"),
            F.round(F.lit(100.0) * F.sum("errors") / F.nullif(F.sum("calls"), F.lit(0)), 1).alias("error_pct"),
            F.max("p95_ms").alias("worst_p95_ms"),
        )
        .orderBy(F.desc("calls"), "method", "route")
        .limit(limit)
    )
