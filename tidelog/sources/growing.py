"""A streaming source that follows text files while they grow.

Spark's own file stream takes a file once, as it is when first seen. Here an offset says for every
file how far it was read, so each line arrives once: when it is appended, when the file is renamed
(a file is known by device and inode, not by name), and when it is truncated or its inode is used
anew, which a smaller size or other first bytes show. Files need a path that the driver and every
executor see (a mounted folder). Lines that are gone before their batch is read are lost.

The offset comes from the files alone, so a restart needs nothing but Spark's checkpoint. With
`multiline` a file counts only up to its last record start: a record that is still being written
stays in the file until it is whole, instead of in a state store.
"""

from __future__ import annotations

import glob
import json
import os
import re
import stat
import sys
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

_SCHEMA = "message string, file string, modified timestamp, host string, file_id string, position bigint"
_HEAD = 256  # first bytes that tell a new file from an old one
_BLOCK = 1 << 16
_PIECE = 32 << 20  # bytes a task reads
_TRIES = 20
_START = re.compile(rb"\n[^ \t\r\x0b\x0c\n]")

# Python workers need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _opened(path: str, file_id: str):
    file = open(path, "rb")
    facts = os.fstat(file.fileno())
    if f"{facts.st_dev}:{facts.st_ino}" != file_id:
        file.close()
        raise FileNotFoundError(f"{path} is another file now")
    return file


def _head(file, length: int) -> int:
    file.seek(0)
    return zlib.crc32(file.read(length))


def _closed(file, size: int, multiline: bool) -> int:
    """Where the last unfinished line, or with `multiline` the last record, of a file begins."""
    end = size
    while end > 0:
        begin = max(0, end - _BLOCK)
        file.seek(begin)
        block = file.read(min(end + 1, size) - begin)  # one byte of the block after this one
        if multiline:
            found = [m.start() for m in _START.finditer(block)]
            at = found[-1] if found else -1
        else:
            at = block.rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end = begin
    return 0


@dataclass
class Piece(InputPartition):
    """Records of a file that begin in [start, end); what was read before ends at `first`, and
    nothing from `last` on is read. `length` and `head` say which file it must still be."""

    path: str
    name: str
    host: str
    file_id: str
    modified: int
    first: int
    start: int
    end: int
    last: int
    length: int
    head: int


def _lines(file, at: int, last: int) -> Iterator[tuple[int, bytes]]:
    while at < last:
        line = file.readline(last - at)
        if not line:
            return
        yield at, line
        at += len(line)


def _records(file, piece: Piece, multiline: bool) -> Iterator[tuple[int, bytes]]:
    """(position, text) of the records that begin in the piece.

    Indented lines continue the record before them; a blank line ends it, and indented lines
    after that, or with nothing before them, stand alone. Lines belong to the piece in which the
    last unindented line before them begins.
    """
    at = piece.start
    if piece.start > piece.first:
        file.seek(piece.start - 1)
        at = piece.start - 1 + len(file.readline())
    else:
        file.seek(at)
    mine = piece.start == piece.first
    held: list[bytes] = []
    began = 0
    for position, line in _lines(file, at, piece.last):
        text = line.rstrip(b"\r\n")
        begins = not multiline or line[:1] not in (b" ", b"\t", b"\r", b"\x0b", b"\x0c", b"\n")
        if begins:
            if position >= piece.end:
                break
            mine = True
        if not mine:
            continue
        if multiline and not begins and text and held:
            held.append(text)
            continue
        if held:
            yield began, b"\n".join(held)
            held = []
        if not text:
            continue
        if begins:
            began, held = position, [text]
        else:
            yield position, text
    if held:
        yield began, b"\n".join(held)


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.globs = json.loads(options["globs"])
        self.host = options.get("host", "")
        self.host_pattern = options.get("host_pattern")
        self.multiline = options.get("multiline") == "true"
        self.from_end = options.get("read_from") == "end"
        self.ignore_older = float(options.get("ignore_older") or "inf")
        self.progress = options.get("progress")
        self.idle = float(options.get("idle") or 1)
        self.known: dict[str, tuple] = {}

    def _files(self) -> dict[str, tuple[str, os.stat_result]]:
        """Path and facts of every file, by its identity. Of two names of one file the first stays."""
        found: dict[str, tuple[str, os.stat_result]] = {}
        for path in sorted({p for g in self.globs for p in glob.glob(g, recursive=True)}):
            if os.path.islink(path) and not os.path.exists(path):
                continue
            facts = os.stat(path)
            if stat.S_ISREG(facts.st_mode):
                found.setdefault(f"{facts.st_dev}:{facts.st_ino}", (path, facts))
        return found

    @staticmethod
    def _settled(look, *given):
        """Result of `look`, once more if a file was renamed or removed meanwhile: an offset that
        lacks a file that exists would let the next one read it again."""
        for _ in range(_TRIES):
            try:
                return look(*given)
            except FileNotFoundError:
                time.sleep(0.05)
        return look(*given)

    def _ended(self) -> dict[str, list[int]]:
        if not self.progress or not os.path.exists(f"{self.progress}/ended.json"):
            return {}
        with open(f"{self.progress}/ended.json") as file:
            return json.load(file)

    def _note(self, ended: dict[str, list[int]]) -> None:
        """Written before an offset that depends on it, so a restart never reads a record again."""
        os.makedirs(self.progress, exist_ok=True)
        draft = f"{self.progress}/ended-{uuid.uuid4().hex}.tmp"
        with open(draft, "w") as file:
            json.dump(ended, file)
        os.replace(draft, f"{self.progress}/ended.json")

    @staticmethod
    def _grown_since(path: str, size: int, ended: list[int]) -> bool:
        at, length, head = ended
        with open(path, "rb") as file:
            return size >= at and _head(file, length) == head

    def _offset(self) -> dict:
        now = time.time()
        before = self._ended()
        ended: dict[str, list[int]] = {}
        out: dict[str, dict] = {}
        for key, (path, facts) in self._files().items():
            state = (facts.st_size, facts.st_mtime_ns)
            if key not in self.known or self.known[key][0] != state:
                with _opened(path, key) as file:
                    length = min(_HEAD, facts.st_size)
                    closed = _closed(file, facts.st_size, self.multiline)
                    self.known[key] = (state, closed, length, _head(file, length))
            _, at, length, head = self.known[key]
            # A quiet file's last record is over; what is appended later is not part of it.
            if self.progress:
                if now - facts.st_mtime >= self.idle:
                    at = facts.st_size
                elif key in before and self._grown_since(path, facts.st_size, before[key]):
                    at = max(at, before[key][0])
                if at > self.known[key][1]:
                    ended[key] = [at, length, head]
            out[key] = {
                "path": path, "at": at, "size": facts.st_size, "modified": facts.st_mtime_ns // 1000,
                "length": length, "head": head,
            }
        if ended != before and self.progress:
            self._note(ended)
        return out

    def initialOffset(self) -> dict:
        """Files that count as read before the stream began."""
        found = self._settled(self._offset)
        edge = (time.time() - self.ignore_older) * 1_000_000
        return {k: v for k, v in found.items() if self.from_end or v["modified"] < edge}

    def latestOffset(self) -> dict:
        return self._settled(self._offset)

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return self._settled(self._pieces, start, end)

    def _pieces(self, start: dict, end: dict) -> list[Piece]:
        paths = {key: path for key, (path, _) in self._files().items()}
        pieces: list[Piece] = []
        for key, new in end.items():
            old = start.get(key)
            if old == new or key not in paths:
                continue
            first = old["at"] if old and self._same(paths[key], old, new) else 0
            host = self.host
            if self.host_pattern:
                found = re.search(self.host_pattern, paths[key])
                host = found.group(1) if found else host
            for at in range(first, new["at"], _PIECE):
                pieces.append(
                    Piece(
                        paths[key], new["path"], host, key, new["modified"], first, at,
                        min(at + _PIECE, new["at"]), new["at"], new["length"], new["head"],
                    )
                )
        return pieces

    @staticmethod
    def _same(path: str, old: dict, new: dict) -> bool:
        """Whether the file only grew since `old`."""
        if new["size"] < old["size"] or new["length"] < old["length"]:
            return False
        if new["length"] == old["length"]:
            return new["head"] == old["head"]
        with open(path, "rb") as file:
            return _head(file, old["length"]) == old["head"]

    def read(self, partition: Piece) -> Iterator[tuple]:
        modified = datetime.fromtimestamp(partition.modified / 1e6, timezone.utc)
        try:
            file = _opened(partition.path, partition.file_id)
        except FileNotFoundError:  # renamed since the batch was planned
            found = self._settled(self._files).get(partition.file_id)
            if found is None:
                return
            file = _opened(found[0], partition.file_id)
        with file:
            # After a truncation no file holds these lines.
            if os.fstat(file.fileno()).st_size < partition.last or _head(file, partition.length) != partition.head:
                return
            for position, text in _records(file, partition, self.multiline):
                yield (
                    text.decode("utf-8", "replace"), partition.name, modified, partition.host or None,
                    partition.file_id, position,
                )


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidelog_growing"

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(dict(self.options))


def follow_lines(
    spark: SparkSession,
    globs: str | list[str],
    host: str = "",
    host_pattern: str | None = None,
    multiline: bool = False,
    read_from: str = "beginning",
    ignore_older_seconds: float | None = None,
    progress: str | None = None,
    idle_seconds: float = 1.0,
) -> DataFrame:
    """Stream of the lines, or records, that are appended to the files of `globs`.

    Columns: message, file, modified, host, file_id (device and inode), position (first byte).
    `host_pattern` has a group that takes the host from the path. `read_from="end"` skips what
    the files hold at the start, `ignore_older_seconds` skips files untouched for longer then;
    both come back with their next line. Blank lines are dropped.

    A last line without line end, and with `multiline` the last record, waits for what follows.
    With `progress`, a folder of the stream's own, it also ends after `idle_seconds` of quiet.
    """
    spark.dataSource.register(GrowingLines)
    reader = spark.readStream.format(GrowingLines.name())
    given = {
        "globs": json.dumps([globs] if isinstance(globs, str) else globs), "host": host,
        "host_pattern": host_pattern, "multiline": str(multiline).lower(), "read_from": read_from,
        "ignore_older": ignore_older_seconds, "progress": progress, "idle": idle_seconds,
    }
    return reader.options(**{k: v for k, v in given.items() if v is not None}).load()
