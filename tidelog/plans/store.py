"""Where the tables of one installation live."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidelog.sources import tables

# Partitioned by day; the others are keyed and written whole as versions, or append-only.
DAY_TABLES = [
    "log_entries", "metrics", "host_metrics", "log_rollup", "endpoint_rollup", "latency_sketch",
    "error_group_bucket",
]
VERSIONED = ["alert_rules", "alert_state", "error_groups", "cert_expiry"]
APPENDED = ["alert_events", "maintenance_log", "db_metrics"]


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, table: str) -> DataFrame:
        if table in VERSIONED:
            return tables.read_version(self.spark, self.path(table), table)
        return tables.read_table(self.spark, self.path(table), table)

    def replace(self, table: str, df: DataFrame) -> None:
        tables.write_version(df, self.path(table))

    def append(self, table: str, df: DataFrame) -> None:
        if table in DAY_TABLES:
            tables.append_rows(df, self.path(table))
        else:
            df.write.mode("append").parquet(self.path(table))
