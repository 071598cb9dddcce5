"""Functions over the rows of a task in their order, a bounded block of them at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

_BLOCK_ROWS = 500
_BLOCK_BYTES = 1 << 22


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, _BLOCK_ROWS):
            yield from batch.slice(at, _BLOCK_ROWS).to_pylist()


def runs(records: Iterator[dict], key: str) -> Iterator[tuple[object, Iterator[dict]]]:
    """Neighbours of equal `key`, each run as a stream."""
    held = next(records, None)
    while held is not None:
        value, rest = held[key], [held]

        def run() -> Iterator[dict]:
            while rest and rest[0][key] == value:
                row = rest.pop()
                if (following := next(records, None)) is not None:
                    rest.append(following)
                yield row

        own = run()
        yield value, own
        for _ in own:  # whatever the caller left
            pass
        held = rest[0] if rest else None


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row.values() if isinstance(v, (str, bytes)))
        if len(held) >= _BLOCK_ROWS or size > _BLOCK_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def map_records(df: DataFrame, function, ddl: str) -> DataFrame:
    """`function` over the rows of each task, as dictionaries in their order."""

    schema = df.sparkSession.createDataFrame([], ddl).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(function(_records(batches)), to_arrow_schema(schema))

    return df.mapInArrow(run, schema)


def names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]
