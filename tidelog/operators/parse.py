"""Log lines to `log_entries` rows: one projection of built-in expressions, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog import schemas
from tidelog.functions import patterns as P
from tidelog.functions import text as X

# A name map or an allowlist is configuration; above this many rows it is joined by shuffle.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast only after counting: beyond `limit` rows Spark is left to shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def service_and_kind(raw: DataFrame, name_map: DataFrame | None = None) -> DataFrame:
    """Adds service, kind and stream. `name_map` (stem, name) wins over the file name."""

    def has(name: str) -> Column:
        return F.col(name).isNotNull() if name in raw.columns else F.lit(False)

    def get(name: str) -> Column:
        return F.col(name) if name in raw.columns else F.lit(None).cast("string")

    path = get("file")
    named = F.lit(None).cast("string")
    if name_map is not None and "file" in raw.columns:
        # Of two names for one stem, always the same one.
        names = name_map.groupBy(F.col("stem").alias("_stem")).agg(F.min("name").alias("_named"))
        raw = raw.withColumn("_stem", X.file_stem(path)).join(small_side(names), "_stem", "left")
        named = F.col("_named")
    nginx = F.startswith(path, F.lit(P.NGINX_PREFIX))
    of_file = F.when(nginx, F.replace(X.basename(path), F.lit(".log"), F.lit(""))).otherwise(
        F.coalesce(named, F.regexp_replace(X.basename(path), P.STREAM_SUFFIX, ""))
    )
    service = (
        F.when(has("container_name"), get("container_name"))
        .when(has("_SYSTEMD_UNIT"), get("_SYSTEMD_UNIT"))
        .when(has("file"), of_file)
        .otherwise(F.lit("unknown"))
    )
    kind = (
        F.when(has("container_name"), F.lit("docker"))
        .when(has("_SYSTEMD_UNIT"), F.lit("systemd"))
        .when(has("file"), F.when(nginx, F.lit("nginx")).otherwise(F.lit("pm2")))
        .otherwise(F.lit("unknown"))
    )
    stream = F.when(
        kind == "pm2",
        F.when(F.contains(path, F.lit(P.STDERR_MARK)), F.lit("stderr")).otherwise(F.lit("stdout")),
    )
    return raw.withColumns({"service": service, "kind": kind, "stream": stream}).drop(
        "_stem", "_named"
    )


def parse_logs(
    raw: DataFrame,
    name_map: DataFrame | None = None,
    source_tz: str = "UTC",
    host: str | None = None,
    ingest_ts: Column | None = None,
    keep_stream: bool = False,
    whole_segment: bool = False,
    honour_utc_suffix: bool = False,
    redact_first: bool = False,
    origin: Column | None = None,
) -> DataFrame:
    """(ts, host, service, kind, severity, body, attrs) of raw lines or events.

    `raw` has `message` and any of file, container_name, _SYSTEMD_UNIT, timestamp, host, id.
    A line without a readable time stamp gets the event's, else `ingest_ts` (default: the
    moment the query runs). Request facts are read before the body is redacted, unless
    `redact_first`.
    """
    named = service_and_kind(raw, name_map)
    staged = named.withColumn("_line", X.strip_escapes(F.coalesce("message", F.lit(""))))
    staged = staged.withColumn("_clean", X.redact(F.col("_line")))
    staged = staged.withColumn("_upper", F.upper("_line"))
    if redact_first:
        staged = staged.withColumn("_clean_upper", F.upper("_clean"))
        staged = X.with_request_facts(staged, "_clean", "_clean_upper", whole_segment)
        tail = X.http_tail(F.col("_line"))
    else:
        staged = X.with_request_facts(staged, "_line", "_upper", whole_segment)
        tail = F.col("_tail")

    candidates = [X.line_timestamp(F.col("_line"), source_tz, honour_utc_suffix)]
    if "timestamp" in raw.columns:
        candidates.append(F.col("timestamp").cast("timestamp"))
    candidates.append(ingest_ts if ingest_ts is not None else F.current_timestamp())
    if host is not None:
        host_column = F.lit(host)
    else:
        host_column = F.col("host") if "host" in raw.columns else F.lit("unknown")
    out = {
        "ts": F.coalesce(*candidates),
        "host": host_column,
        "service": F.col("service"),
        "kind": F.col("kind"),
        "severity": X.severity(F.col("_line"), F.col("_upper"), tail),
        "body": F.col("_clean"),
        "attrs": X.pack_facts().cast(schemas.ATTRS_DDL),
    }
    if keep_stream:
        out["stream"] = F.col("stream")
    if origin is not None:
        out["origin"] = origin
    kept = [F.col("id")] if "id" in raw.columns else []
    return staged.select(*kept, *[c.alias(n) for n, c in out.items()])


def only_selected(logs: DataFrame, selected: DataFrame) -> DataFrame:
    """Rows of the selected services; an empty selection keeps nothing."""
    names = selected.select("service").dropDuplicates()
    return logs.join(small_side(names), "service", "left_semi").select(*logs.columns)


def nginx_mode(logs: DataFrame, mode: str = "full") -> DataFrame:
    """`full` keeps all nginx rows, `errors` those with status >= 400, `off` none."""
    nginx = F.col("kind") == "nginx"
    if mode == "full":
        return logs
    if mode == "off":
        return logs.filter(~nginx)
    if mode == "errors":
        return logs.filter(~nginx | F.coalesce(F.col("attrs.status") >= 400, F.lit(False)))
    raise ValueError(f"unknown nginx mode {mode!r}")


def process_list(text: DataFrame, column: str = "value") -> DataFrame:
    """One row per process of process-list JSON, tolerating notices printed around it."""
    documents = F.split(F.col(column), r"\r?\n|(?<=\])(?=\[)")
    array_text = r"(\[\s*(?:\{.*\}\s*)?\])"
    others = [F.col(c) for c in text.columns if c != column]
    return (
        text.select(*others, F.explode(documents).alias("_doc"))
        .select(*others, X.extract(F.col("_doc"), array_text, 1).alias("_doc"))
        .select(*others, F.explode(F.from_json("_doc", schemas.PROCESS_LIST_DDL)).alias("p"))
        .filter(F.coalesce(F.col("p.name"), F.lit("")) != "")
    )


def pm2_log_index(text: DataFrame, column: str = "value") -> DataFrame:
    """(service, path, stem, glob, needs_glob, mapped) of every log stream a process writes.

    `glob` covers the stream and its rotations; it is needed only outside the default log
    folders. `mapped` marks streams whose file name does not already tell the service.
    """
    paths = F.array(
        *[
            F.coalesce(X.extract(F.col(f"p.{n}"), r"(?s)(.+)", 1), F.col(f"p.pm2_env.{n}"))
            for n in ("pm_out_log_path", "pm_err_log_path", "pm_log_path")
        ]
    )
    processes = process_list(text, column)
    others = [c for c in processes.columns if c != "p"]
    rows = processes.select(
        *others, F.col("p.name").alias("service"), F.explode(paths).alias("path")
    ).filter((F.coalesce(F.col("path"), F.lit("")) != "") & (F.col("path") != "/dev/null"))
    stem = X.file_stem(F.col("path"))
    base = F.when(stem == F.col("path"), F.regexp_replace("path", r"\.log\z", "")).otherwise(stem)
    folder = F.regexp_replace("path", r"/[^/]*\z", "")
    from_name = F.regexp_replace(X.basename(F.col("path")), P.STREAM_SUFFIX, "")
    return rows.select(
        *others,
        "service",
        "path",
        stem.alias("stem"),
        F.concat(base, F.lit("*.log")).alias("glob"),
        (~folder.rlike(P.DEFAULT_LOG_DIR)).alias("needs_glob"),
        (from_name != F.col("service")).alias("mapped"),
    )


def name_map(index: DataFrame) -> DataFrame:
    """(stem, name) for the streams whose file name disagrees with the process name."""
    return index.filter("mapped").select("stem", F.col("service").alias("name")).distinct()
