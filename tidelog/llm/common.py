"""What the operators share: table access, word hashes, bounded training rows, broadcasts."""

from __future__ import annotations

import ctypes
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.session import shared_dir

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BLOCK = 1 << 20  # bytes of text hashed together; the tables of powers have this length
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_powers: list[np.ndarray] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores before it as no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` written to the shared folder once and read back: later work restarts from there."""
    path = fresh_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text, remainder 0 by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> list[tuple]:
    """At most `rows` labelled texts of either class, chosen by a hash of the id.

    Only rows outside the held-out fifth; rows without id, label or text are left out. The
    choice depends on nothing but the ids, so every run fits the same model.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"))
    known = known.where(F.col("_label").isin(0, 1) & F.col("_id").isNotNull())
    known = known.where(~is_held_out(F.col("_id"))).groupBy("_id").agg(F.max("_label").alias("_label"))
    order = [F.xxhash64("_id"), F.col("_id")]
    picked = None
    for value in (0, 1):
        part = known.where(F.col("_label") == value).orderBy(*order).limit(rows)
        picked = part if picked is None else picked.union(part)
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    found = texts.join(F.broadcast(picked), "_id").where(F.col("_text").isNotNull())
    # One text an id, the least in byte order: repeated rows don't add to what is collected.
    found = found.groupBy("_id", "_label").agg(F.min("_text").alias("_text"))
    return sorted((r[0], r[1], r[2]) for r in found.select("_id", "_label", "_text").collect())


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Newton steps for a small dense logistic regression; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty * len(x))
    ridge[-1] = 1e-9
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _tables() -> list[np.ndarray]:
    if not _powers:
        for base in (_MULTIPLIER, _INVERSE):
            power = np.full(_BLOCK + 1, base, dtype=np.uint64)
            power[0] = 1
            _powers.append(np.cumprod(power, dtype=np.uint64))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every bit of `h`."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hash_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of a buffer no longer than `_BLOCK`."""
    up, down = _tables()
    raw = np.frombuffer(data, dtype=np.uint8)
    blank = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    value = (sums[end] - sums[start]) * down[start]
    return mix(value ^ ((end - start).astype(np.uint64) << np.uint64(40))), start


def word_hashes(texts: list, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of all texts, and where each text begins.

    Null texts have no words. `lower` folds A-Z first. Equal words have equal hashes wherever
    they stand, so hashes may be compared between tasks.
    """
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    pending: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        if not pending:
            return
        data = b" ".join(b for _, b in pending)
        value, start = _hash_block(data)
        ends = np.cumsum([len(b) + 1 for _, b in pending])
        number = np.bincount(np.searchsorted(ends, start, side="right"), minlength=len(pending))
        for (at, _), n in zip(pending, number):
            counts[at] += n
        hashes.append(value)
        pending.clear()

    for at, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if lower:
            data = data.translate(_LOWER)
        if size + len(data) + 1 > _BLOCK:
            flush()
            size = 0
        if len(data) > _BLOCK:
            words = data.split()
            for part in _pieces(words):
                value, _ = _hash_block(part)
                counts[at] += len(value)
                hashes.append(value)
            continue
        pending.append((at, data))
        size += len(data) + 1
    flush()
    offsets = np.concatenate(([0], np.cumsum(counts)))
    return np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64), offsets


def _pieces(words: list[bytes]) -> Iterator[bytes]:
    """A very long text in buffers of at most `_BLOCK` bytes; a longer word gets a digest."""
    part: list[bytes] = []
    size = 0
    for word in words:
        if len(word) > _BLOCK:
            word = b"\x00%d:%d:%d" % (len(word), zlib.crc32(word), zlib.adler32(word))
        if size + len(word) + 1 > _BLOCK:
            yield b" ".join(part)
            part, size = [], 0
        part.append(word)
        size += len(word) + 1
    if part:
        yield b" ".join(part)


def sequence_hash(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` consecutive entries (one fewer result per extra entry)."""
    count = len(words) - length + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:count].copy()
    for k in range(1, length):
        out = mix(out * _MULTIPLIER + words[k : k + count])
    return out


def blocks(batches: Iterator, rows: int = 1000) -> Iterator:
    """The Arrow batches of a task in blocks of few rows, so that memory stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]
        give_back()


def text_blocks(batches: Iterator, chars: int = 1 << 20) -> Iterator:
    """The batches of a task in blocks whose texts have about `chars` characters together."""
    for batch in batches:
        # Not by `.str`: its accessor and the column refer to each other, which keeps the batch's texts.
        sizes = np.array([len(t) if isinstance(t, str) else 0 for t in batch["text"]], dtype=np.int64) + 64
        number = (np.cumsum(sizes) - sizes) // chars
        for rows in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(number)) + 1):
            if len(rows):
                yield batch.iloc[rows[0] : rows[-1] + 1]
        give_back()


@lru_cache(maxsize=1)
def _trim():
    """The C library's call for that; None where it has no such call."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns freed memory of this worker to the system.

    Freed texts and arrays otherwise stay with the process, more with every batch, and a worker
    outlives its task: an executor holds them beside what its next stage needs.
    """
    pa.default_memory_pool().release_unused()
    if _trim() is not None:
        _trim()(0)


def one_thread() -> None:
    """Native libraries of a Python worker must not start threads of their own."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
