"""Five-minute rollups per service and per endpoint, and what is computed from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import text as X
from tidelog.functions.quantiles import grouped_quantiles
from tidelog.functions.timing import BUCKET_SECONDS, bucket

# The quantiles kept per bucket, and the Apdex target T with its limit 4T.
QUANTILES = {"p50_ms": 0.50, "p95_ms": 0.95, "p99_ms": 0.99}
APDEX_T_MS = 500
APDEX_4T_MS = 2000
# Size of a sketch, and the share of all values by which its ranks are off at that size.
SKETCH_K = 400
SKETCH_RANK_ERROR = 0.0075


def _failed() -> Column:
    """Server error by status, or a line the parser judged an error."""
    return F.coalesce(F.col("status") >= 500, F.lit(False)) | F.coalesce(
        X.is_error(F.col("severity")), F.lit(False)
    )


def service_rollup(resolved: DataFrame, seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Counts, exact latency quantiles and Apdex counts per (bucket, host, service)."""
    timed = F.col("dur").isNotNull()
    rows = resolved.withColumn("bucket", bucket(F.col("ts"), seconds))
    out = grouped_quantiles(
        rows,
        ["bucket", "host", "service"],
        "dur",
        QUANTILES,
        counts={
            "errors": X.is_error(F.col("severity")),
            "warns": F.col("severity") == "WARN",
            "total": F.lit(True),
            "req_errors": timed & _failed(),
            "apdex_s": F.col("dur") <= APDEX_T_MS,
            "apdex_t": (F.col("dur") > APDEX_T_MS) & (F.col("dur") <= APDEX_4T_MS),
        },
        maximum="max_ms",
        counted="timed",
    )
    return out.select(
        "bucket", "host", "service", "errors", "warns", "total", *QUANTILES, "max_ms",
        "timed", "req_errors", "apdex_s", "apdex_t",
    )


def endpoint_rollup(resolved: DataFrame, seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Calls, failures and exact quantiles per (bucket, host, service, method, route).

    One row per request counts: lines that open a request are left out, lines without a
    phase are whole requests.
    """
    rows = (
        resolved.filter(
            F.col("route").isNotNull() & (F.coalesce(F.col("phase"), F.lit("end")) == "end")
        )
        .withColumn("bucket", bucket(F.col("ts"), seconds))
        .withColumn("method", F.coalesce("method", F.lit("")))
    )
    out = grouped_quantiles(
        rows,
        ["bucket", "host", "service", "method", "route"],
        "dur",
        QUANTILES,
        counts={
            "calls": F.lit(True),
            "errors": _failed(),
            "clienterr": F.col("status").between(400, 499),
        },
        maximum="max_ms",
    )
    return out.select(
        "bucket", "host", "service", "method", "route", "calls", "errors", "clienterr",
        *QUANTILES, "max_ms",
    )


def combine_rollups(rollup: DataFrame, seconds: int = 3600) -> DataFrame:
    """Rollups of a coarser window: counts are added, rates and Apdex divided afterwards."""
    names = ["errors", "warns", "total", "timed", "req_errors", "apdex_s", "apdex_t"]
    summed = rollup.groupBy(bucket(F.col("bucket"), seconds).alias("bucket"), "host", "service").agg(
        *[F.sum(n).alias(n) for n in names], F.max("max_ms").alias("max_ms")
    )
    timed = F.nullif(F.col("timed"), F.lit(0))
    return summed.select(
        "bucket",
        "host",
        "service",
        *names,
        "max_ms",
        (F.col("timed") / seconds).alias("req_per_sec"),
        (F.col("req_errors") / timed).alias("error_rate"),
        ((F.col("apdex_s") + F.col("apdex_t") / 2.0) / timed).alias("apdex"),
    )


def latency_sketches(resolved: DataFrame, seconds: int = BUCKET_SECONDS) -> DataFrame:
    """A mergeable sketch of the durations per (bucket, host, service).

    A KLL sketch has a few KB at `SKETCH_K`, however many values went in, and is built on the map
    side first. Buckets without a duration have no row.
    """
    rows = resolved.filter(F.col("dur").isNotNull()).withColumn("bucket", bucket(F.col("ts"), seconds))
    return rows.groupBy("bucket", "host", "service").agg(
        F.count("*").alias("timed"),
        F.min("dur").alias("min_ms"),
        F.max("dur").alias("max_ms"),
        F.kll_sketch_agg_double("dur", F.lit(SKETCH_K)).alias("sketch"),
    )


def merge_sketches(sketches: DataFrame, seconds: int, keys: tuple[str, ...] = ("host", "service")) -> DataFrame:
    """Sketches of a coarser window, or of fewer keys: an hour, a month, a service on all hosts.

    Merging again gives what merging at once gives, within the bound of `SKETCH_K`.
    """
    merged = sketches.groupBy(bucket(F.col("bucket"), seconds).alias("bucket"), *keys)
    return merged.agg(
        F.sum("timed").alias("timed"),
        F.min("min_ms").alias("min_ms"),
        F.max("max_ms").alias("max_ms"),
        F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch"),
    )


def sketch_quantiles(sketches: DataFrame, quantiles: dict[str, float] | None = None) -> DataFrame:
    """Percentiles of each sketch, its other columns kept.

    An answer is a value that occurred, whose rank is off by `SKETCH_RANK_ERROR` of all values at
    most in 99 of 100 cases; sketches of fewer than `SKETCH_K` values are exact. The least and the
    greatest value are kept beside the sketch and are exact always.
    """
    wanted = quantiles or QUANTILES
    answers = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(q) for q in wanted.values()]))
    found = sketches.withColumn("_answers", answers)
    picked = {name: F.col("_answers")[i] for i, name in enumerate(wanted)}
    return found.withColumns(picked).drop("_answers", "sketch")


def latency_summary(rollup: DataFrame) -> DataFrame:
    """Per service: quantiles averaged over buckets by request count, and the worst bucket."""
    weight = F.greatest(F.coalesce(F.col("timed"), F.lit(0)), F.lit(1))
    rows = rollup.filter(F.col("p95_ms").isNotNull()).withColumn("w", weight)

    def mean(name: str) -> Column:
        known = F.sum(F.when(F.col(name).isNotNull(), F.col("w")))
        return F.sum(F.col(name) * F.col("w")) / F.nullif(known, F.lit(0))

    return rows.groupBy("service").agg(
        mean("p50_ms").alias("p50_ms"),
        mean("p95_ms").alias("p95_ms"),
        F.max("p95_ms").alias("worst_p95_ms"),
    )
