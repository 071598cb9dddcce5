"""Flat token-id files with 64-bit document offsets, written and read by Spark tasks.

A dataset is a folder with, for each partition, `part-N.ids` (the ids of its documents one
after the other, unsigned, little-endian, 2 or 4 bytes wide) and `part-N.idx` (for each document
its doc_id, start and count as three little-endian 64-bit integers; `start` counts the ids of all
documents before it in the whole dataset). Partitions hold ascending ranges of doc_id.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import fresh_folder, text_blocks
from tidelog.llm.tokens import encoder

_NULL_ID = -(2**63) + 1  # in files, for rows without doc_id
_ENTRY = np.dtype([("doc_id", "<i8"), ("start", "<i8"), ("count", "<i8")])
_MANIFEST = "part long, ids string, sizes string, docs long, tokens long"


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_token_files(
    docs: DataFrame, folder: str, vocabulary_path: str, end_id: int, width: int = 2, partitions: int | None = None
) -> DataFrame:
    """Encode all texts into `folder` in ascending doc_id order; returns the manifest.

    Documents are dealt into ranges of doc_id, each task streams its own range to files of its
    own, named by attempt, so a task that runs twice leaves an unused file and nothing wrong.
    Rows with equal doc_id stay together in the order of their texts; a null doc_id comes first.
    A null text is empty: it has the end id only. Manifest rows: part, ids, sizes, docs,
    tokens, base (ids before the part, a prefix sum over the parts' totals).
    """
    spark = docs.sparkSession
    system, path = _place(folder)
    system.create_dir(path, recursive=True)

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary_path, width)
        end = end_id.to_bytes(width, "little")
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        target, where = _place(name)
        count = tokens = 0
        ids = sizes = None
        for rows in text_blocks(batches):
            if ids is None:
                ids = target.open_output_stream(where + ".ids")
                sizes = target.open_output_stream(where + ".sizes")
            found = encode.encode([t if isinstance(t, str) else "" for t in rows["text"]])
            entry = np.zeros(len(rows), dtype=_ENTRY)
            entry["doc_id"] = rows["doc_id"].to_numpy()
            entry["count"] = [len(x) // width + 1 for x in found]
            entry["start"] = tokens + np.cumsum(entry["count"]) - entry["count"]
            ids.write(end.join(found) + end)
            sizes.write(entry.tobytes())
            count += len(rows)
            tokens += int(entry["count"].sum())
        if ids is not None:
            ids.close()
            sizes.close()
            yield pd.DataFrame([[part, name + ".ids", name + ".sizes", count, tokens]], columns=["part", "ids", "sizes", "docs", "tokens"])

    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), "text")
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = base.repartitionByRange(count, "doc_id").sortWithinPartitions("doc_id", "text")
    parts = sorted(dealt.mapInPandas(store, _MANIFEST).collect())
    before = np.concatenate(([0], np.cumsum([p.tokens for p in parts], dtype=np.int64)))
    rows = [(*p, int(b)) for p, b in zip(parts, before)]
    manifest = spark.createDataFrame(rows, _MANIFEST + ", base long")
    return _write_offsets(manifest.repartition(max(1, len(rows)), "part") if rows else manifest, folder)


def _write_offsets(manifest: DataFrame, folder: str) -> DataFrame:
    """Second pass, a task per few parts: offsets inside a part become offsets in the dataset."""

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                entry = read_array(row.sizes, _ENTRY).copy()
                entry["start"] += row.base
                name = f"{folder}/part-{row.part:06d}-{uuid.uuid4().hex}.idx"
                target, where = _place(name)
                with target.open_output_stream(where) as out:
                    out.write(entry.tobytes())
                yield pd.DataFrame([[row.part, row.ids, name, row.docs, row.tokens, row.base]], columns=["part", "ids", "idx", "docs", "tokens", "base"])

    schema = "part long, ids string, idx string, docs long, tokens long, base long"
    rows = sorted(manifest.mapInPandas(store, schema).collect())
    return manifest.sparkSession.createDataFrame(rows, schema)


def read_array(uri: str, dtype: np.dtype) -> np.ndarray:
    """A flat file as an array: mapped where it lies on a local disk, else read."""
    system, path = _place(uri)
    if system.get_file_info(path).size == 0:
        return np.zeros(0, dtype=dtype)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with system.open_input_file(path) as file:
        return np.frombuffer(file.readall(), dtype=dtype)


def read_token_files(manifest: DataFrame, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    ids_crc32 is the crc32 of the ids as little-endian unsigned 32-bit integers.
    """

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids = read_array(row.ids, np.dtype(f"<u{width}"))
                entry = read_array(row.idx, _ENTRY)
                for at in range(0, len(entry), 5000):
                    own = entry[at : at + 5000]
                    first = own["start"] - row.base
                    checks = [zlib.crc32(ids[a : a + n].astype("<u4").tobytes()) for a, n in zip(first.tolist(), own["count"].tolist())]
                    yield pd.DataFrame({"doc_id": own["doc_id"].astype(np.int64), "start": own["start"], "n_tokens": own["count"], "ids_crc32": np.array(checks, dtype=np.int64)})

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    count = max(1, manifest.count())
    rows = manifest.repartition(count, "part").mapInPandas(load, schema)
    return rows.withColumn("doc_id", F.expr(f"nullif(doc_id, {_NULL_ID})"))


def token_files(docs: DataFrame, vocabulary_path: str, end_id: int, width: int = 2) -> DataFrame:
    """Write `docs` to a fresh folder of the shared place and read the documents back."""
    folder = fresh_folder(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, vocabulary_path, end_id, width), width)
