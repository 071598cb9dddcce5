"""Buckets and look-back windows. Every look-back is relative to an explicit `as_of`."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_SECONDS = 300


def bucket(ts: Column, seconds: int = BUCKET_SECONDS) -> Column:
    """Start of the tumbling bucket; five minutes divide the epoch, so no origin is needed.

    The same buckets as `F.window(ts, ...)`, which only a watermarked stream needs.
    """
    at = F.unix_seconds(ts)
    return F.timestamp_seconds(at - F.pmod(at, F.lit(seconds)))


def utc(moment: datetime | str) -> datetime:
    """`as_of` as an aware UTC datetime."""
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment)
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return moment.astimezone(timezone.utc)


def instant(moment: datetime | str) -> Column:
    return F.lit(utc(moment).isoformat()).cast("timestamp")


def utc_day(moment: datetime | str) -> date:
    return utc(moment).date()


def align(moment: datetime | str, seconds: int = BUCKET_SECONDS) -> datetime:
    """Down to the boundary of the bucket `moment` lies in."""
    moment = utc(moment)
    over = moment.timestamp() % seconds
    return moment - timedelta(seconds=over)


def align_up(moment: datetime | str, seconds: int = BUCKET_SECONDS) -> datetime:
    low = align(moment, seconds)
    return low if low == utc(moment) else low + timedelta(seconds=seconds)


def in_time_range(
    df: DataFrame,
    low: datetime | str | None = None,
    high: datetime | str | None = None,
    column: str = "ts",
    open_low: bool = False,
    closed_high: bool = False,
) -> Column:
    """Condition for [low, high), with the matching one on `day` where `df` is partitioned by
    it, so that whole partitions are skipped (also when such conditions are joined by OR)."""
    at = F.col(column)
    parts = []
    if low is not None:
        parts.append(at > instant(low) if open_low else at >= instant(low))
        if "day" in df.columns:
            parts.append(F.col("day") >= F.lit(utc_day(low)))
    if high is not None:
        parts.append(at <= instant(high) if closed_high else at < instant(high))
        if "day" in df.columns:
            parts.append(F.col("day") <= F.lit(utc_day(high)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def is_recent(df: DataFrame, as_of: datetime | str, seconds: int, column: str = "ts") -> Column:
    """Condition for rows newer than `as_of - seconds` (open edge, no upper edge)."""
    return in_time_range(df, utc(as_of) - timedelta(seconds=seconds), column=column, open_low=True)


def time_range(
    df: DataFrame,
    low: datetime | str | None = None,
    high: datetime | str | None = None,
    column: str = "ts",
    open_low: bool = False,
    closed_high: bool = False,
) -> DataFrame:
    return df.filter(in_time_range(df, low, high, column, open_low, closed_high))


def recent(df: DataFrame, as_of: datetime | str, seconds: int, column: str = "ts") -> DataFrame:
    return df.filter(is_recent(df, as_of, seconds, column))
