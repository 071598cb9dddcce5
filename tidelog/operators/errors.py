"""Errors grouped by fingerprint, with counts per five minutes and triage states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import text as X
from tidelog.functions.timing import bucket

# Fixed values
STATES = ["open", "ignored", "resolved"]
SAMPLE_CHARS = 500


def error_rows(logs: DataFrame) -> DataFrame:
    """Error lines with fingerprint and first line. Rows without service or body have none."""
    rows = logs.filter(X.is_error(F.col("severity")))
    return rows.select(
        X.error_fp(F.col("service"), F.col("body")).alias("fp"),
        "id", "ts", "host", "service", "severity",
        X.first_line(F.col("body")).alias("sample"),
    ).filter(F.col("fp").isNotNull())


def group_stats(errors: DataFrame) -> DataFrame:
    """One row per fingerprint: extent, count, and the latest line as sample."""
    return errors.groupBy("fp").agg(
        F.min("host").alias("host"),
        F.min("service").alias("service"),
        F.min("severity").alias("severity"),
        F.max_by(F.left("sample", F.lit(SAMPLE_CHARS)), F.struct("ts", "id")).alias("sample"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.count("*").alias("occurrences"),
    )


def group_buckets(errors: DataFrame) -> DataFrame:
    """Occurrences per (bucket, fp); recomputing a bucket gives the same row again."""
    return errors.groupBy(bucket(F.col("ts")).alias("bucket"), "fp").agg(
        F.count("*").alias("occurrences")
    )


def merge_error_groups(old: DataFrame, new: DataFrame, add_counts: bool = True) -> DataFrame:
    """Groups after `new` came in: counts add up, the newer sample wins, resolved reopens.

    With `add_counts=False` the count of `new` replaces the old one (it was recomputed from
    all buckets), which makes a repeated merge harmless.
    """
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.fp") == F.col("n.fp"), "full_outer")

    def first_of(name: str):
        return F.coalesce(F.col(f"o.{name}"), F.col(f"n.{name}")).alias(name)

    zero = F.lit(0).cast("bigint")
    added = F.coalesce("o.occurrences", zero) + F.coalesce("n.occurrences", zero)
    replaced = F.coalesce("n.occurrences", "o.occurrences")
    newer = F.coalesce(F.col("n.last_seen") >= F.col("o.last_seen"), F.col("o.fp").isNull())
    state = (
        F.when(F.col("o.fp").isNull(), F.lit("open"))
        .when(F.col("n.fp").isNotNull() & (F.col("o.state") == "resolved"), F.lit("open"))
        .otherwise(F.col("o.state"))
    )
    return both.select(
        first_of("fp"), first_of("host"), first_of("service"), first_of("severity"),
        F.when(newer, F.col("n.sample")).otherwise(F.col("o.sample")).alias("sample"),
        first_of("first_seen"),
        F.greatest("o.last_seen", "n.last_seen").alias("last_seen"),
        (added if add_counts else replaced).alias("occurrences"),
        state.alias("state"),
    )


def window_counts(buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups seen in the given buckets, with their count there and over their lifetime.

    Cut `buckets` to the window first (`timing.recent(buckets, as_of, secs, "bucket")`).
    """
    seen = buckets.groupBy("fp").agg(F.sum("occurrences").alias("in_window"))
    return groups.join(seen, "fp").select(
        "fp", "service", "severity", "state", "in_window", "occurrences"
    )


def list_groups(groups: DataFrame, include_ignored: bool = False, limit: int = 100) -> DataFrame:
    """The newest groups; ignored ones only on request."""
    if not include_ignored:
        groups = groups.filter(F.col("state") != "ignored")
    return groups.orderBy(F.desc("last_seen"), "fp").limit(limit)


def set_group_state(groups: DataFrame, changes: DataFrame) -> DataFrame:
    """New triage states from `changes` (fp, state); a state outside the three is an error."""
    allowed = F.col("state").isin(*STATES)
    checked = changes.select(
        "fp",
        F.when(allowed, F.col("state"))
        .otherwise(
            F.raise_error(
                F.concat(
                    F.lit("state must be open, ignored or resolved, not "),
                    F.coalesce(F.col("state"), F.lit("NULL")),
                )
            )
        )
        .alias("_state"),
    )
    joined = groups.join(checked, "fp", "left")
    return joined.withColumn("state", F.coalesce("_state", "state")).select(*groups.columns)
