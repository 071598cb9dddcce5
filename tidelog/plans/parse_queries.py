"""Queries for sources, ingest and line parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import text as X
from tidelog.operators import metrics as M
from tidelog.operators import parse as PARSE
from tidelog.operators.diagnose import newest_files
from tidelog.plans.registry import query
from tidelog.plans.standins import base, ctes, from_sql, logs, view
from tidelog.sources import files as FILES
from tidelog.sources import ingest

# -- the line parser in SQL (RE2), applied to a column named `line` ---------------------------------

_KEYED = (
    r"(?i)\b(?:response_?time(?:_?ms)?|duration_?(?:ms)?|elapsed(?:_?ms)?|latency(?:_?ms)?|took|rt)"
    r"\b\"?\s*[=:]\s*\"?(\d+(?:\.\d+)?)\s*(ms|s\b)?"
)
_TAIL = r"\((\d+) ms\)\s+(\d{3})\s*$"
_STATUS = r"(?i)\b(?:status(?:_?code)?|statuscode)\b\"?\s*[=:]\s*\"?(\d{3})\b"
_RID = (
    r"(?i)\b(?:request_?id|req_?id|correlation_?id|trace_?id|x-request-id)\"?\s*[=:]\s*\"?"
    r"([A-Za-z0-9_\-]{6,64})"
)
_METHOD = r"(?i)\bmethod\"?\s*[=:]\s*\"?(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b"
_URL = r"(?i)\burl\"?\s*[=:]\s*\"?(/[^\s\",]*)"


def _x(pattern: str, group: int) -> str:
    return f"nullif(regexp_extract(line, '{pattern}', {group}), '')"


def route_sql(path: str) -> str:
    for pattern, stand_in in [
        (r"\?.*$", ""),
        (
            "/[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
            "/:id",
        ),
        ("/[0-9a-fA-F]{16,}", "/:id"),
        (r"/\d+", "/:id"),
    ]:
        path = f"regexp_replace({path}, '{pattern}', '{stand_in}', 'g')"
    return path


def redact_sql(text: str) -> str:
    for pattern, stand_in in [
        (
            r"(?i)(password|passwd|pwd|secret|api[_-]?key|apikey|token|authorization)"
            r"\s*[=:]\s*\S+",
            r"\1=***",
        ),
        (r"(?i)bearer\s+[A-Za-z0-9\-\._~\+/]+=*", "Bearer ***"),
        (r"eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]*", "***"),
        ("AKIA[0-9A-Z]{16}", "***"),
        (r"://([^:/@\s]+):([^@/\s]+)@", r"://\1:***@"),
    ]:
        text = f"regexp_replace({text}, '{pattern}', '{stand_in}', 'g')"
    return text


SEVERITY_SQL = f"""CASE
    WHEN contains(upper(line), 'FATAL') OR contains(upper(line), 'CRITICAL') THEN 'FATAL'
    WHEN contains(upper(line), 'ERROR') THEN 'ERROR'
    WHEN contains(upper(line), 'WARN') THEN 'WARN'
    WHEN contains(upper(line), 'DEBUG') OR contains(upper(line), 'TRACE') THEN 'DEBUG'
    WHEN contains(upper(line), 'INFO') OR contains(upper(line), 'NOTICE') THEN 'INFO'
    WHEN contains(line, '❌') OR contains(line, '🔴') THEN 'ERROR'
    WHEN contains(line, '⚠') THEN 'WARN'
    WHEN CAST({_x(_TAIL, 2)} AS INT) >= 500 THEN 'ERROR'
    WHEN CAST({_x(_TAIL, 2)} AS INT) >= 400 THEN 'WARN' ELSE 'INFO' END"""

FACTS_SQL = f"""
    coalesce(
      CAST({_x(_KEYED, 1)} AS DOUBLE)
        * CASE WHEN regexp_extract(line, '{_KEYED}', 2) = 's' THEN 1000.0 ELSE 1.0 END,
      CAST({_x(r"\((\d+(?:\.\d+)?) ?ms\)", 1)} AS DOUBLE),
      CAST({_x(r"-\s+(\d+(?:\.\d+)?)\s*ms\s*$", 1)} AS DOUBLE)) AS duration_ms,
    coalesce(CAST({_x(_STATUS, 1)} AS INT), CAST({_x(_TAIL, 2)} AS INT)) AS status,
    upper({_x(_METHOD, 1)}) AS method,
    {route_sql(_x(_URL, 1))} AS route,
    {_x(_RID, 1)} AS req_id,
    CASE WHEN {_x(_RID, 1)} IS NULL THEN NULL
         WHEN regexp_matches(line, '(?i)(incoming request|request (start|started|received|begin))')
         THEN 'start'
         WHEN regexp_matches(line,
              '(?i)(request (completed|complete|finished|end|ended)|response sent)')
         THEN 'end' END AS phase"""

_FACTS = ["duration_ms", "status", "method", "route", "req_id", "phase"]
# A method without any other fact makes no attributes.
_KEPT_FACTS = ", ".join(
    f"CASE WHEN coalesce(CAST(duration_ms AS VARCHAR), CAST(status AS VARCHAR), route, req_id) "
    f"IS NOT NULL THEN {f} END AS {f}"
    for f in _FACTS
)


def _flat(parsed: DataFrame, *columns: str) -> DataFrame:
    return parsed.select(*columns, *[F.col(f"attrs.{f}").alias(f) for f in _FACTS])


def _parsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = FILES.spread_out(view(spark, sf_dir, "raw_lines"))
    return PARSE.parse_logs(lines, host="host0", keep_stream=True)


_LINES_SQL = f"""
    SELECT *, {FACTS_SQL}, {SEVERITY_SQL} AS severity, {redact_sql("line")} AS body,
           CAST(regexp_extract(line, '^\\[([^\\]]+)\\]', 1) AS TIMESTAMP) AS ts,
           regexp_replace(regexp_extract(file, '([^/]+)$', 1),
                          '-(out|error)(-\\d+)?(__[^/]*)?\\.log$', '') AS service,
           CASE WHEN contains(file, '-error') THEN 'stderr' ELSE 'stdout' END AS stream
    FROM (SELECT id, file, message AS line FROM raw_lines)"""


@query(
    ctes("raw_lines", lines=_LINES_SQL)
    + f"""SELECT id, ts, 'host0' AS host, service, 'pm2' AS kind, severity, body, stream,
                 {_KEPT_FACTS} FROM lines"""
)
def parsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["id", "ts", "host", "service", "kind", "severity", "body", "stream"]
    return _flat(_parsed_lines(spark, sf_dir), *columns)


# Whole documents as container events: no time stamp at the start, long multi-line text.
@query(
    f"""WITH lines AS (
          SELECT doc_id, line, {FACTS_SQL}, {SEVERITY_SQL} AS severity, {redact_sql("line")} AS body
          FROM (SELECT doc_id, text AS line FROM documents))
        SELECT doc_id AS id, 'docker' AS kind, source AS service, severity, md5(body) AS body_md5,
               {_KEPT_FACTS} FROM lines JOIN documents USING (doc_id)"""
)
def parsed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = FILES.spread_out(base(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("message"),
        F.col("source").alias("container_name"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("timestamp"),
    )
    parsed = PARSE.parse_logs(events).withColumn("body_md5", F.md5("body"))
    return _flat(parsed, "id", "kind", "service", "severity", "body_md5")


@query(f"SELECT doc_id, {redact_sql('text')} AS body FROM documents")
def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = FILES.spread_out(base(spark, sf_dir, "documents"))
    return docs.select("doc_id", X.redact(F.col("text")).alias("body"))


_PATH = r"regexp_replace(url, '^https?://[^/]+', '')"


@query(
    f"""SELECT route, count(*) AS pages FROM (SELECT {route_sql(_PATH)} AS route FROM pages)
        GROUP BY route"""
)
def normalised_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^https?://[^/]+", "")
    routes = base(spark, sf_dir, "pages").select(X.normalise_route(path).alias("route"))
    return routes.groupBy("route").agg(F.count("*").alias("pages"))


# Coloured terminal output: every event type written in escapes, cleaned again.
@query("SELECT event_id, concat('[', event_type, '] ', props) AS line FROM events")
def stripped_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coloured = F.concat(
        F.lit("\x1b]0;title\x07[\x1b[1;36m"), F.col("event_type"), F.lit("\x1b[0m] \x1bM"), F.col("props")
    )
    events = base(spark, sf_dir, "events")
    return events.select("event_id", X.strip_escapes(coloured).alias("line"))


# Multi-line records of every document: lines numbered inside the document, joined again.
@query(
    r"""WITH lines AS (
          SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
        marked AS (
          SELECT *, CASE WHEN regexp_matches(line, '^\S') THEN 1 ELSE 0 END AS head
          FROM lines WHERE line <> ''),
        numbered AS (
          SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY n) AS rec FROM marked)
        SELECT CAST(doc_id AS VARCHAR) AS file, string_agg(line, chr(10) ORDER BY n) AS message
        FROM numbered GROUP BY doc_id, rec, CASE WHEN rec = 0 THEN n END"""
)
def assembled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base(spark, sf_dir, "documents")
    lines = docs.select(
        F.col("doc_id").cast("string").alias("file"),
        F.lit(0).cast("bigint").alias("block"),
        F.posexplode(F.split("text", "\n")).alias("row", "message"),
    )
    return FILES.assemble_records(lines).select("file", "message")


_INDEXED = ctes("files") + """
    SELECT service, max(mtime) AS mtime,
           arg_max(path, (mtime, path, size)) AS path, arg_max(size, (mtime, path, size)) AS size
    FROM files GROUP BY service"""


@query(_INDEXED)
def newest_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest_files(view(spark, sf_dir, "files"))


@query(
    ctes("raw_lines")
    + """SELECT kind, service, count(*) AS n FROM (
           SELECT 'pm2' AS kind, regexp_replace(regexp_extract(file, '([^/]+)$', 1),
                  '-(out|error)(-\\d+)?(__[^/]*)?\\.log$', '') AS service FROM raw_lines
           UNION ALL SELECT 'docker', role FROM conversations
           UNION ALL SELECT 'systemd', concat(source, '.service') FROM documents)
         GROUP BY kind, service""".replace("\\\\", "\\")
)
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = view(spark, sf_dir, "raw_lines").select("message", "file")
    containers = base(spark, sf_dir, "conversations").select(
        F.col("text").alias("message"), F.col("role").alias("container_name")
    )
    journal = base(spark, sf_dir, "documents").select(
        F.col("text").alias("message"), F.concat("source", F.lit(".service")).alias("_SYSTEMD_UNIT")
    )
    merged = PARSE.service_and_kind(FILES.union_sources(lines, containers, journal))
    return merged.groupBy("kind", "service").agg(F.count("*").alias("n"))


_SELECTED_SQL = "SELECT DISTINCT concat('svc', CAST(user_id % 5 AS STRING)) AS service FROM events"


@query(
    ctes("logs", selected=_SELECTED_SQL)
    + "SELECT id, ts, service FROM logs WHERE service IN (SELECT service FROM selected)"
)
def selected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = PARSE.only_selected(logs(spark, sf_dir), view(spark, sf_dir, "selected"))
    return kept.select("id", "ts", "service")


@query(
    ctes("logs")
    + """SELECT id, service, CASE WHEN service < 'svc4' THEN 'nginx' ELSE kind END AS kind, status
         FROM logs WHERE service >= 'svc4' OR status >= 400"""
)
def nginx_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nginx = F.when(F.col("service") < "svc4", F.lit("nginx")).otherwise(F.col("kind"))
    kept = PARSE.nginx_mode(logs(spark, sf_dir).withColumn("kind", nginx), "errors")
    return kept.select("id", "service", "kind", F.col("attrs.status").alias("status"))


@query(
    ctes("raw_lines")
    + r"""SELECT regexp_matches(file, '__\d{4}-\d{2}-\d{2}_') AS rotated, count(*) AS n
          FROM raw_lines GROUP BY 1"""
)
def rotated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = view(spark, sf_dir, "raw_lines")
    return lines.groupBy(X.is_rotated(F.col("file")).alias("rotated")).agg(F.count("*").alias("n"))


# -- ingest -----------------------------------------------------------------------------------------

# Events as the collector sends them: some lines blank, some cut off, some fields missing.
_NDJSON = """
    SELECT event_id, CASE
        WHEN event_id % 11 = 0 THEN '   '
        WHEN event_id % 7 = 0 THEN concat('{"ts":"', CAST(CAST(ts AS TIMESTAMP) AS STRING), '"')
        ELSE concat('{"ts":"', CAST(CAST(ts AS TIMESTAMP) AS STRING), '","service":"',
                    CASE WHEN user_id % 9 = 0 THEN ''
                         ELSE concat('svc', CAST(user_id % 8 AS STRING)) END,
                    '","message":"', event_type, ' of ', CAST(user_id AS STRING), '\\r",',
                    '"attrs":{"duration_ms":', CAST(CAST(floor(value) AS INT) AS STRING),
                    ',"status":', CAST(200 + user_id % 3 AS STRING), '}}') END AS value
    FROM events"""


def _ndjson(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # Spark SQL reads a backslash in a literal as an escape, so the JSON `\r` needs two.
    sql = _NDJSON.replace("\\r", "\\\\r")
    return FILES.read_ndjson(FILES.spread_out(from_sql(spark, sf_dir, sql, "events")))


@query(
    """WITH e AS (
         SELECT CAST(CAST(ts AS TIMESTAMP) AS VARCHAR) AS t,
                CASE WHEN user_id % 9 = 0 THEN 'unknown'
                     ELSE concat('svc', CAST(user_id % 8 AS VARCHAR)) END AS service,
                concat(event_type, ' of ', CAST(user_id AS VARCHAR)) AS body,
                CAST(floor(value) AS INT) AS ms, CAST(200 + user_id % 3 AS INT) AS status
         FROM events WHERE event_id % 11 <> 0 AND event_id % 7 <> 0)
       SELECT CAST(concat('0x', substr(fp, 1, 15)) AS BIGINT) AS id, CAST(t AS TIMESTAMP) AS ts,
              'edge' AS host, service, 'unknown' AS kind, body, fp,
              CAST(CASE WHEN ms >= 0 THEN ms END AS DOUBLE) AS duration_ms, status
       FROM (SELECT *, sha1(concat(t, '|', service, '|', body, chr(13))) AS fp FROM e)"""
)
def ingested_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _ = _ndjson(spark, sf_dir)
    rows = ingest.to_log_rows(events, default_host="edge")
    return rows.select(
        "id", "ts", "host", "service", "kind", "body", "fp", "attrs.duration_ms", "attrs.status"
    )


@query(
    """SELECT concat('{"ts":"', CAST(CAST(ts AS TIMESTAMP) AS VARCHAR), '"') AS line FROM events
       WHERE event_id % 11 <> 0 AND event_id % 7 = 0"""
)
def rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ndjson(spark, sf_dir)[1]


# Documents delivered as log lines, twice: every line stays, exact copies too, and none comes double.
@query(
    """SELECT sha1(concat('2024-01-01 00:00:00|', source, '|', text)) AS fp, source AS service,
              md5(replace(text, chr(13), '')) AS body_md5, count(*) AS n FROM documents GROUP BY 1, 2, 3"""
)
def deduplicated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = base(spark, sf_dir, "documents").select(
        F.lit("2024-01-01 00:00:00").alias("ts"), F.col("source").alias("service"), F.col("text").alias("body")
    )
    rows = ingest.to_log_rows(events)
    lines = ingest.merge_deliveries(rows, rows)
    return lines.groupBy("fp", "service", F.md5("body").alias("body_md5")).agg(F.count("*").alias("n"))


# -- snapshots ------------------------------------------------------------------------------------------

_PROCESSES = """
    SELECT p_brand AS host, concat('notice: [PM2] ', p_type, chr(10), '[',
             string_agg(concat('{"name":"', CASE WHEN p_size % 10 = 0 THEN '' ELSE p_name END,
               '","pm_err_log_path":"/dev/null","monit":{"cpu":', CAST(p_size AS STRING),
               '.5,"memory":', CAST(p_partkey * 1000 AS STRING), '},"pm2_env":{"status":"online",',
               '"pm_out_log_path":"/srv/', CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END,
               '-out-', CAST(p_size AS STRING), '.log"}}'), ','), ']') AS value
    FROM part GROUP BY p_brand, p_type"""


def _process_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _PROCESSES.replace("string_agg(", "array_join(collect_list(").replace(
        "'.log\"}}'), ',')", "'.log\"}}')), ',')"
    ).replace("chr(10)", "char(10)")
    return from_sql(spark, sf_dir, sql, "part")


@query(
    """SELECT TIMESTAMP '2024-01-01 00:00:00' AS ts, p_brand AS host, p_name AS service,
              'pm2' AS kind, p_size + 0.5::DOUBLE AS cpu, p_partkey * 1000 AS mem_bytes,
              0 AS restarts, 'online' AS status FROM part WHERE p_size % 10 <> 0"""
)
def process_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts")
    return M.process_metrics(_process_lists(spark, sf_dir).select(at, "host", "value"))


@query(
    """SELECT host, service, path, stem, "glob", true AS needs_glob, file <> service AS mapped FROM (
         SELECT p_brand AS host, p_name AS service,
                CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS file,
                concat('/srv/', file, '-out-', p_size, '.log') AS path,
                concat('/srv/', file) AS stem, concat('/srv/', file, '*.log') AS "glob"
         FROM part WHERE p_size % 10 <> 0)"""
)
def process_log_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PARSE.pm2_log_index(_process_lists(spark, sf_dir))


# The process list decides the service name where the file name says something else.
@query(
    """WITH idx AS (
         SELECT DISTINCT p_name, concat('/srv/', CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END)
                AS stem FROM part WHERE p_size % 10 <> 0),
       m AS (SELECT stem, min(p_name) AS p_name FROM idx WHERE stem <> concat('/srv/', p_name) GROUP BY 1),
       lines AS (SELECT p_partkey, concat('/srv/', p_type) AS stem, p_type FROM part)
       SELECT p_partkey AS id, coalesce(m.p_name, l.p_type) AS service
       FROM lines l LEFT JOIN m USING (stem)"""
)
def named_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = PARSE.pm2_log_index(_process_lists(spark, sf_dir))
    names = PARSE.name_map(index)
    lines = base(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("/srv/"), "p_type", F.lit("-out-1.log")).alias("file"),
    )
    return PARSE.service_and_kind(lines, names).select("id", "service")
