"""Day-partitioned Parquet tables: append, keyed upsert, range replacement, partition listing."""

from __future__ import annotations

import re
import time
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import schemas
from tidelog.session import cut_lineage
from tidelog.sources import ingest

KEPT_VERSIONS = 3
FILE_BYTES = 64 << 20
KEPT_SECONDS = 86400  # a version that was current so long ago may still be read by a query


def _filesystem(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _filesystem(spark, path)
    return fs.exists(where)


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table with its declared schema; an absent table is an empty one."""
    declared = schemas.schema(table)
    if not exists(spark, path):
        return spark.createDataFrame([], declared)
    return spark.read.schema(declared).parquet(path)


def append_rows(df: DataFrame, path: str, sort_by: list[str] | None = None) -> None:
    """Append to a table partitioned by day.

    `rebalance` gathers a day's rows into few files and splits a day that is too big for
    one task; sorting inside a file makes its row-group statistics selective.
    """
    out = df.hint("rebalance", "day")
    if sort_by:
        out = out.sortWithinPartitions(*sort_by)
    out.write.mode("append").partitionBy("day").parquet(path)


def write_logs(rows: DataFrame, path: str) -> None:
    append_rows(rows, path, sort_by=["service", "ts"])


def overwrite_days(df: DataFrame, path: str) -> None:
    """Replace exactly the days present in `df`; other days are not touched.

    Dynamic overwrite stages the new files first, so `df` may read the table it replaces.
    """
    _overwrite(df.hint("rebalance", "day"), path, "day")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` replace rows of `old` with an equal key (all measures)."""
    kept = old.join(new.select(*keys), keys, "left_anti")
    return kept.select(*old.columns).unionByName(new.select(*old.columns))


def upsert_days(spark: SparkSession, path: str, table: str, new: DataFrame) -> None:
    """Keyed upsert into a day-partitioned table, rewriting only the days `new` touches."""
    new = new.withColumn("day", F.to_date("bucket")) if "day" not in new.columns else new
    old = read_table(spark, path, table)
    touched = new.select("day").distinct()
    merged = upsert(old.join(touched, "day", "left_semi"), new, [*schemas.KEYS[table], "day"])
    overwrite_days(merged, path)


def with_days(buckets: DataFrame) -> DataFrame:
    """Buckets with their days. The comparison is true for every bucket there can be: Spark prunes
    the days of a scan by a joined frame only if that frame is filtered."""
    return buckets.filter(F.col("bucket") >= F.lit("0001-01-01").cast("timestamp")).withColumn("day", F.to_date("bucket"))


def replace_buckets(
    spark: SparkSession, path: str, table: str, new: DataFrame, buckets: DataFrame
) -> None:
    """The given buckets become exactly the rows of `new`, which must lie inside them.

    Rows of other buckets on the same days are kept; other days are not read. A bucket that
    has no rows any more ends up empty, and a day without any row is dropped, since the
    overwrite leaves days alone that it gets no row for: it shows in their files, which are then
    the same as before. Rows are computed and written once.
    """
    old = read_table(spark, path, table)
    dated = with_days(buckets)
    days = dated.select("day").distinct()
    kept = old.join(F.broadcast(days), "day", "left_semi").join(F.broadcast(dated), ["day", "bucket"], "left_anti")
    fresh = new.withColumn("day", F.to_date("bucket"))
    stored = set(list_days(spark, path)) & {row["day"] for row in days.collect()}  # one row a day
    before = {day: _files_of(spark, path, day) for day in stored}
    overwrite_days(kept.select(*old.columns).unionByName(fresh.select(*old.columns)), path)
    drop_days(spark, path, [day for day, files in before.items() if _files_of(spark, path, day) == files])


def _files_of(spark: SparkSession, path: str, day: date) -> set[str]:
    fs, where = _filesystem(spark, f"{path}/day={day.isoformat()}")
    return {s.getPath().getName() for s in fs.listStatus(where)}


def stage_version(df: DataFrame, root: str) -> str:
    """Write a whole new version of a keyed table where no reader looks yet."""
    staged = f"{root}/_staged-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(staged)
    return staged


def _versions(spark: SparkSession, root: str) -> list[str]:
    if not exists(spark, root):
        return []
    fs, where = _filesystem(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()]
    return sorted(n for n in names if n.startswith("v-"))


def publish_version(
    spark: SparkSession, root: str, staged: str, keep_seconds: int = KEPT_SECONDS
) -> None:
    """Make a staged version the newest one with a single rename: readers see the old or the
    new table, never a mix. A version goes when it is not among the last ones and the one after
    it was published more than `keep_seconds` ago, so no query of that length loses its files."""
    fs, _ = _filesystem(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    now = time.time_ns()
    if not fs.rename(path(staged), path(f"{root}/v-{now:020d}")):
        raise OSError(f"could not publish {staged}")
    versions = _versions(spark, root)
    for old, following in zip(versions[:-KEPT_VERSIONS], versions[1:]):
        if now - int(following[2:]) >= keep_seconds * 10**9:
            fs.delete(path(f"{root}/{old}"), True)


def write_version(df: DataFrame, root: str) -> None:
    publish_version(df.sparkSession, root, stage_version(df, root))


def current_version(spark: SparkSession, root: str) -> str | None:
    return max(_versions(spark, root), default=None)


def read_version(spark: SparkSession, root: str, table: str) -> DataFrame:
    version = current_version(spark, root)
    if version is None:
        return spark.createDataFrame([], schemas.schema(table))
    return spark.read.schema(schemas.schema(table)).parquet(f"{root}/{version}")


_DAY_FOLDER = re.compile(r"day=\d{4}-\d{2}-\d{2}")


def list_days(spark: SparkSession, path: str) -> list[date]:
    """Day partitions of a table, from the folder names alone (no data is read)."""
    if not exists(spark, path):
        return []
    fs, where = _filesystem(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()]
    return sorted(date.fromisoformat(n[4:]) for n in names if _DAY_FOLDER.fullmatch(n))


def drop_days(spark: SparkSession, path: str, days: list[date]) -> None:
    fs, _ = _filesystem(spark, path)
    for day in days:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day={day.isoformat()}"), True)


def close_days(spark: SparkSession, path: str, through: date) -> None:
    """Note that the days up to `through` take no more rows. Written before they are dropped."""
    fs, _ = _filesystem(spark, path)
    fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_closed-{through.isoformat()}"), True).close()


def closed_through(spark: SparkSession, path: str) -> date | None:
    if not exists(spark, path):
        return None
    fs, where = _filesystem(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return max((date.fromisoformat(n[8:]) for n in names if n.startswith("_closed-")), default=None)


def compact_days(
    spark: SparkSession, path: str, table: str, most_files: int = 8, before: date | None = None
) -> list[date]:
    """Rewrite days of more than `most_files` files, and far more than their bytes need, into files
    of the session's advisory partition size. Rows stay what they are, sorted as `write_logs`
    leaves them. The days' ledger shrinks with them: one entry a line. Returns the days.

    All days are replaced by one dynamic overwrite, staged first. As with `purge`, nothing else
    may write these days meanwhile.
    """
    if not list_days(spark, path):
        return []
    many = (F.col("files") > most_files) & (F.col("files") > 8 * F.ceil(F.col("bytes") / FILE_BYTES))
    if before is not None:
        many = many & (F.col("day") < F.lit(before))
    days = sorted(r["day"] for r in partition_sizes(spark, path).filter(many).select("day").collect())
    if not days:
        return []
    # Files of different deliveries may have more columns than the table declares.
    stored = spark.read.option("mergeSchema", "true").parquet(path)
    rows = stored.filter(F.col("day").isin(days)).hint("rebalance", "day")
    if table == "log_entries":
        rows = rows.sortWithinPartitions("day", "service", "ts")
    _overwrite(rows, path, "day")
    ledger = _ledger(path)
    if exists(spark, ledger) and not _open_marks(spark, ledger):
        entries = spark.read.schema(_LEDGER_DDL).parquet(ledger).filter(F.col("day").isin(days))
        entries = entries.groupBy("key", "day", "prefix").agg(F.max("copies").alias("copies"))
        _overwrite(entries.hint("rebalance", "day", "prefix"), ledger, "day", "prefix")
    return days


def _overwrite(rows: DataFrame, path: str, *folders: str) -> None:
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*folders).parquet(path)


def partition_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Bytes and files per day. Only the file listing is used: no file is opened."""
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(path)
        .select("path", "length")
    )
    return (
        listing.withColumn("day", F.regexp_extract("path", r"/day=(\d{4}-\d{2}-\d{2})/", 1).try_cast("date"))
        .groupBy("day")
        .agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    )


def _ledger(path: str) -> str:
    return f"{path}.keys"


_LEDGER_DDL = "key string, copies bigint, day date, prefix string"
_LEDGER_PREFIX = 1  # hexadecimal digits: 16 folders a day


def _known_copies(spark: SparkSession, path: str, days: list[date]) -> DataFrame:
    """How often each line of the given days is stored: read from the ledger of these days. After
    a run that did not end, the stored rows of the days count too."""
    ledger = _ledger(path)
    if not exists(spark, ledger):
        return spark.createDataFrame([], "day date, key string, known bigint")
    kept = spark.read.schema(_LEDGER_DDL).parquet(ledger).filter(F.col("day").isin(days))
    kept = kept.select("day", "prefix", "key", "copies")
    if _open_marks(spark, ledger) and exists(spark, path):
        rows = spark.read.schema("key string, day date").parquet(path).filter(F.col("day").isin(days))
        prefix = F.left("key", F.lit(_LEDGER_PREFIX)).alias("prefix")
        stored = rows.filter(F.col("key").isNotNull()).groupBy("day", prefix, "key")
        kept = kept.unionByName(stored.agg(F.count(F.lit(1)).alias("copies")))
    return kept.groupBy("day", "key").agg(F.max("copies").alias("known"))


def _open_marks(spark: SparkSession, ledger: str) -> list:
    fs, where = _filesystem(spark, ledger)
    return [s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith("_open-")]


def expire_ledger(spark: SparkSession, path: str) -> None:
    """Drop the ledger's days before the oldest day of the table."""
    days = list_days(spark, path)
    if days:
        drop_days(spark, _ledger(path), [d for d in list_days(spark, _ledger(path)) if d < days[0]])


def ingest_rows(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame | None:
    """Append the rows that are not stored yet; returns the delivery's distinct rows, None if
    there are none.

    A ledger beside the table says how often each line is stored, by day and first digit of its
    key; a delivery reads the days it has lines of. Running it twice changes nothing: a mark
    stands from before the rows are written until the ledger has them, and where a mark is left
    over, the next run counts the stored rows themselves. One delivery at a time. It is
    written to the shared folder first: a retried task must not parse it again and see another
    clock.
    """
    dated = ingest.split_undated(rows)[0]
    lines = cut_lineage(ingest.counted(dated))
    days = [r["day"] for r in lines.select("day").distinct().collect()]  # one row a day
    if not days:
        return None
    known = _known_copies(spark, path, days)
    known = lines.join(known, ["day", "key"], "left").withColumn("known", F.coalesce("known", F.lit(0).cast("bigint")))
    ledger = _ledger(path)
    fs, _ = _filesystem(spark, ledger)
    old = _open_marks(spark, ledger) if exists(spark, ledger) else []
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/_open-{uuid.uuid4().hex}")
    fs.create(mark, False).close()
    write_logs(ingest.numbered(known).drop("origin", "occurrence"), path)
    more = known.filter(F.col("copies") > F.col("known")) if not old else known
    entries = more.select("key", F.greatest("copies", "known").alias("copies"), "day", F.left("key", F.lit(_LEDGER_PREFIX)).alias("prefix"))
    entries.hint("rebalance", "day", "prefix").write.mode("append").partitionBy("day", "prefix").parquet(ledger)
    for done in [*old, mark]:
        fs.delete(done, False)
    return lines.drop("copies", "key", "origin")
