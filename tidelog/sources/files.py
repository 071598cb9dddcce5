"""Log sources: text files, container and journal exports, newline-delimited JSON."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog import schemas
from tidelog.functions import patterns as P
from tidelog.functions.timing import utc

# Look-back of the two file sources: a file untouched for longer is not read.
PM2_MAX_AGE_SECONDS = 900
NGINX_MAX_AGE_SECONDS = 86400

_ROW_BITS = 33
_CHUNK_LINES = 32768


def _local_path(uri: Column) -> Column:
    """`file:///var/log/a.log` -> `/var/log/a.log` (metadata paths are URL-encoded)."""
    plain = F.regexp_replace(uri, r"^[A-Za-z0-9+.-]+:(//[^/]*)?", "")
    return F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))


def read_lines(
    spark: SparkSession,
    globs: str | list[str],
    streaming: bool = False,
    modified_after: datetime | str | None = None,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Lines of text files with the path they came from.

    Columns: message, file, modified, block (start of the file split). Large files are
    split, so one big file is read by many tasks.
    """
    paths = [globs] if isinstance(globs, str) else globs
    if streaming:
        reader = spark.readStream
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        if len(paths) != 1:
            return union_sources(
                *[read_lines(spark, p, True, None, max_files_per_trigger) for p in paths]
            )
        lines = reader.text(paths[0])
    else:
        reader = spark.read
        if modified_after is not None:
            stamp = utc(modified_after).strftime("%Y-%m-%dT%H:%M:%S")
            reader = reader.option("modifiedAfter", stamp).option("timeZone", "UTC")
        lines = reader.text(paths)
    return lines.select(
        F.col("value").alias("message"),
        _local_path(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def read_recent_lines(
    spark: SparkSession, globs: str | list[str], as_of: datetime | str, max_age_seconds: int
) -> DataFrame:
    """Only files written within `max_age_seconds`; the others are never opened."""
    edge = utc(as_of) - timedelta(seconds=max_age_seconds)
    return read_lines(spark, globs, modified_after=edge)


def recent_only(lines: DataFrame, as_of: datetime | str, max_age_seconds: int) -> DataFrame:
    """The same rule on lines that are already a DataFrame (a landed copy, a stream batch)."""
    edge = (utc(as_of) - timedelta(seconds=max_age_seconds)).isoformat()
    return lines.filter(F.col("modified") > F.lit(edge).cast("timestamp"))


def number_lines(lines: DataFrame) -> DataFrame:
    """Adds `row`, the order of a line inside its (file, block).

    A split is read by one task from start to end, so the row counter of that task orders
    its lines. Apply it directly on the reader, before anything that moves rows.
    """
    order = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return lines.withColumn("row", order)


ROWS_A_TASK = 100_000


def spread_out(df: DataFrame) -> DataFrame:
    """Give every core a share of a source that comes in fewer pieces than there are cores
    (one small or unsplittable file), and no task more than `ROWS_A_TASK` lines on the average: a
    line costs far more to parse than to count. Other sources are left alone: nothing is shuffled."""
    pieces = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK))
    return df.repartition(pieces) if df.rdd.getNumPartitions() < pieces else df


def assemble_records(lines: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Multi-line records: indented lines continue the line before them.

    Input: file, block, row, message, and `carry` columns that are the same for a whole
    file. Output: file, message, block, chunk, part (the last three order the records of a
    file) and `carry`. No task ever holds a file: text is grouped by chunks of at most
    32,768 lines, and only the record that crosses a chunk edge is put together afterwards.
    Empty lines are dropped; an indented line with nothing before it in its file is a record
    of its own.
    """
    of_file = ["file", *carry]
    place = [*of_file, "block", "chunk"]
    placed = lines.withColumn("chunk", F.floor(F.col("row") / _CHUNK_LINES))
    # The NULL tests that joins below would add to some of the uses stand here once for all of
    # them: the uses stay equal, and the text is read and shuffled a single time.
    for column in ("file", "block", "chunk"):
        placed = placed.filter(F.col(column).isNotNull())
    chunked = (
        placed.filter(F.col("message") != "")
        .groupBy(*place)
        .agg(F.array_sort(F.collect_list(F.struct("row", "message"))).alias("rows"))
    )
    text = F.array_join(F.transform("rows", lambda r: r["message"]), "\n")
    pieces = (
        chunked.select(*place, F.split(text, r"\n(?=\S)").alias("parts"))
        .select("*", F.posexplode("parts").alias("part", "message"))
        .withColumn("is_last", F.col("part") == F.size("parts") - 1)
        .withColumn("continues", (F.col("part") == 0) & ~F.col("message").rlike(P.RECORD_START))
        .drop("parts")
    )
    whole = pieces.filter(~F.col("is_last") & ~F.col("continues"))

    # Which chunk does a leading continuation belong to? One narrow row per chunk decides.
    in_file = (
        Window.partitionBy("file")
        .orderBy("block", "chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    owners = pieces.filter("is_last").select(
        "file",
        "block",
        "chunk",
        F.last(
            F.when(~F.col("continues"), F.struct("block", "chunk")), ignorenulls=True
        ).over(in_file).alias("before"),
    )
    edges = (
        pieces.filter(F.col("is_last") | F.col("continues"))
        .join(owners, ["file", "block", "chunk"])
        .withColumn("orphan", F.col("continues") & F.col("before").isNull())
        .withColumn(
            "owner",
            F.when(F.col("continues") & ~F.col("orphan"), F.col("before")).otherwise(
                F.struct("block", "chunk")
            ),
        )
    )
    # A chunk's last record starts at its last part; what follows comes from later chunks.
    # Lines with nothing before them in the file stay single.
    gathered = edges.groupBy(*of_file, "owner", "orphan").agg(
        F.array_sort(F.collect_list(F.struct("block", "chunk", "part", "message"))).alias("p")
    )
    text = F.array_join(F.transform("p", lambda r: r["message"]), "\n")
    joined = gathered.select(
        *of_file,
        F.explode(
            F.when(F.col("orphan"), F.split(text, "\n")).otherwise(F.array(text))
        ).alias("message"),
        F.col("owner.block").alias("block"),
        F.col("owner.chunk").alias("chunk"),
        F.col("p")[0]["part"].alias("part"),
    )
    columns = ["file", "message", "block", "chunk", "part", *carry]
    return whole.select(*columns).unionByName(joined.select(*columns))


def _json_source(
    spark: SparkSession, path: str | list[str], ddl: str, streaming: bool
) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(ddl).json(path)


def read_container_json(
    spark: SparkSession,
    path: str | list[str],
    exclude: list[str] | None = None,
    streaming: bool = False,
) -> DataFrame:
    """Container log export; the containers named in `exclude` (the log store's own) are left out."""
    events = _json_source(spark, path, schemas.CONTAINER_DDL, streaming)
    if exclude:
        # A container without a name is none of those to leave out.
        events = events.filter(F.coalesce(~F.col("container_name").isin(*exclude), F.lit(True)))
    return events


def read_journal_json(
    spark: SparkSession, path: str | list[str], streaming: bool = False
) -> DataFrame:
    return _json_source(spark, path, schemas.JOURNAL_DDL, streaming)


def union_sources(*sources: DataFrame) -> DataFrame:
    """All enabled sources as one table; a column a source lacks is NULL."""
    merged = sources[0]
    for other in sources[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return merged


def read_ndjson(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of newline-delimited JSON. Blank lines are neither.

    One malformed line costs that line only. `attrs` stays JSON text (see `to_log_rows`).
    """
    ddl = (
        "ts string, host string, service string, kind string, severity string, body string, "
        "message string, attrs string, _corrupt string"
    )
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    line = F.trim(F.col(column))
    parsed = (
        lines.filter(line != "")
        .select(line.alias("line"))
        .withColumn("e", F.from_json("line", ddl, options))
        .withColumn(
            "good",
            F.coalesce(
                F.startswith("line", F.lit("{"))
                & F.col("e").isNotNull()
                & F.col("e._corrupt").isNull(),
                F.lit(False),
            ),
        )
    )
    return (
        parsed.filter("good").select("e.*").drop("_corrupt"),
        parsed.filter(~F.col("good")).select("line"),
    )
