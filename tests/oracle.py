"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if hasattr(value, "is_integer") or type(value).__name__ == "Decimal":
        return float(value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def spark_rows(df):
    return _rows(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    result = con.execute(sql)
    return _rows([d[0] for d in result.description], result.fetchall())


def difference(df, con, sql) -> str | None:
    """None when both give the same columns and rows, else what differs first."""
    got_columns, got = spark_rows(df)
    want_columns, want = sql_rows(con, sql)
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2]
        return f"{len(got)} rows != {len(want)}; only in Spark e.g. {extra}"
    for g, w in zip(got, want):
        if g != w:
            return f"spark {g}\n  sql  {w}"
        if [type(x) for x in g] != [type(x) for x in w] and not all(
            isinstance(a, (int, float)) and isinstance(b, (int, float))
            for a, b in zip(g, w)
            if type(a) is not type(b)
        ):
            return f"types differ: {g} / {w}"
    return None


def main() -> None:
    import time

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from tidelog.plans import ORACLES, QUERIES
    from tidelog.session import build_session

    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        begun = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                problem = difference(df, con, ORACLES[name])
                count = con.execute(f"SELECT count(*) FROM ({ORACLES[name]})").fetchone()[0]
            else:
                problem, count = None, df.count()
        except Exception as error:  # noqa: BLE001
            problem, count = f"{type(error).__name__}: {str(error)[:1500]}", -1
        bad += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        if name not in ORACLES and problem is None:
            mark = "rows"
        print(f"{mark} {name:32} {count:8} rows {time.time() - begun:6.2f}s {problem or ''}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
