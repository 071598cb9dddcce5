"""From parsed events to rows of `log_entries`: defaults, content hash, identity of a line.

A line is its time, host, service, text and origin, and its number among equal lines of a
delivery. Equal lines are all kept; a delivery that comes again adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import patterns as P
from tidelog.functions import text as X


def _given(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def _clean(col: Column) -> Column:
    """Carriage returns never reach a text column."""
    return F.replace(col, F.lit("\r"), F.lit(""))


def to_log_rows(events: DataFrame, default_host: str = "unknown") -> DataFrame:
    """Rows of `log_entries` with every default filled in.

    `ts` may be text or a timestamp, `attrs` a struct or JSON text. The hash is taken over
    the values as they arrived. Rows whose time stamp cannot be read keep a NULL `ts`;
    `split_undated` sets them apart.
    """
    columns = events.columns
    types = dict(events.dtypes)

    def field(name: str) -> Column:
        return F.col(name) if name in columns else F.lit(None).cast("string")

    if types.get("ts") == "string":
        ts_text, ts = F.col("ts"), F.col("ts").try_cast("timestamp")
    else:
        ts = F.col("ts").cast("timestamp")
        ts_text = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    attrs = field("attrs")
    if types.get("attrs", "string") == "string":
        attrs = X.attrs_from_json(attrs)

    body = F.coalesce(_given(field("body")), _given(field("message")), F.lit(""))
    service = F.coalesce(_given(field("service")), F.lit("unknown"))
    fp = X.content_hash(F.coalesce(ts_text, F.lit("None")), service, body)
    kept = ["origin"] if "origin" in columns else []
    return events.select(
        X.id_from_hash(fp).alias("id"),
        ts.alias("ts"),
        _clean(F.coalesce(_given(field("host")), F.lit(default_host))).alias("host"),
        _clean(service).alias("service"),
        _clean(F.coalesce(_given(field("kind")), F.lit("unknown"))).alias("kind"),
        _clean(field("severity")).alias("severity"),
        _clean(body).alias("body"),
        attrs.alias("attrs"),
        fp.alias("fp"),
        F.lit(None).cast("string").alias("trace_id"),
        F.lit(None).cast("string").alias("span_id"),
        F.to_date(ts).alias("day"),
        *kept,
    )


def split_undated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.filter(F.col("ts").isNotNull()), rows.filter(F.col("ts").isNull())


def origin(raw: DataFrame) -> Column:
    """What a line came through: its file without the mark of a rotation, else container or unit.

    A file that is followed gives a line a place of its own, which no renaming changes; equal lines
    of it come in different batches and are still different."""
    if {"file_id", "position"} <= set(raw.columns):
        return F.concat_ws("@", "file_id", "position")
    given = {
        "file": F.regexp_replace("file", P.ROTATION_MARK, ""),
        "container_name": F.col("container_name"),
        "_SYSTEMD_UNIT": F.col("_SYSTEMD_UNIT"),
    }
    known = [value for name, value in given.items() if name in raw.columns]
    return F.coalesce(*known, F.lit("")) if known else F.lit("")


def counted(rows: DataFrame) -> DataFrame:
    """Equal rows of one delivery as one, with their number `copies` and what they are: `key`.

    The aggregation runs before the shuffle too, so a line that comes a billion times is no hot
    key. Lines of different hosts or origins are different.
    """
    named = rows if "origin" in rows.columns else rows.withColumn("origin", F.lit(""))
    found = named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias("copies"))
    parts = ["fp", "host", "kind", "severity", F.to_json("attrs"), "origin"]
    texts = [F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("-")) for p in parts]
    return found.withColumn("key", F.sha1(F.concat_ws("\x1f", *texts)))


def numbered(lines: DataFrame) -> DataFrame:
    """The rows that `counted` lines still lack: one for each occurrence after the `known` ones.

    Each gets an id of its own, the same one whenever it is derived again."""
    steps = F.sequence(F.col("known") + 1, F.col("copies"))
    rows = lines.filter(F.col("copies") > F.col("known")).withColumn("occurrence", F.explode(steps))
    own = F.sha1(F.concat_ws("#", "key", "occurrence"))
    return rows.withColumn("id", X.id_from_hash(own)).drop("copies", "known")


def merge_deliveries(*deliveries: DataFrame) -> DataFrame:
    """All lines of several deliveries: what one delivery holds n times is there n times, what
    several deliveries repeat is there as often as in the one that holds it most."""
    every = counted(deliveries[0])
    for other in deliveries[1:]:
        every = every.unionByName(counted(other))
    columns = [c for c in every.columns if c != "copies"]
    most = every.groupBy(*columns).agg(F.max("copies").alias("copies"))
    lines = numbered(most.withColumn("known", F.lit(0).cast("bigint")))
    return lines.select(*deliveries[0].columns)
