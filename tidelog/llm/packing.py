"""Packing of token sequences into windows of fixed length with bounded memory."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import text_blocks
from tidelog.llm.tokens import encoder

_PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
)
_NULL_ID = -(2**63) + 1  # inside tasks, for rows without doc_id
_PART_BITS = 33  # sequence_id = partition * 2**33 + number inside the partition


class Packer:
    """Bounded-space best-fit: at most `open_windows` windows are held.

    Full windows are cut off a long document first. The rest goes into the fullest window with
    room for all of it. When none has, and no further window may be opened, the fullest one is
    filled up with the beginning of the rest and emitted, so no window leaves with a gap.
    `finish` merges what is left: the pieces are joined in turn, cut into full windows, and the
    last remainder into sequences whose lengths are powers of two, which need no padding.
    Pieces are (document key, start, length); `place` returns finished sequences as lists of them.
    """

    def __init__(self, size: int, open_windows: int) -> None:
        self.size, self.limit = size, open_windows
        self.room: list[tuple[int, int]] = []  # (room left, window number), ascending
        self.held: dict[int, list[tuple]] = {}
        self.number = 0

    def place(self, key, length: int) -> list[list[tuple]]:
        done, start = [], 0
        while length - start >= self.size:
            done.append([(key, start, self.size)])
            start += self.size
        while start < length:
            rest = length - start
            at = bisect_left(self.room, (rest, -1))
            if at < len(self.room):
                room, window = self.room.pop(at)
                take = rest
            elif len(self.room) < self.limit:
                self.number += 1
                room, window, take = self.size, self.number, rest
                self.held[window] = []
            else:
                room, window = self.room.pop(0)
                take = room
            self.held[window].append((key, start, take))
            start += take
            if room == take:
                done.append(self.held.pop(window))
            else:
                insort(self.room, (room - take, window))
        return done

    def finish(self) -> list[list[tuple]]:
        pieces = [piece for _, window in self.room for piece in self.held[window]]
        left = sum(length for *_, length in pieces)
        done: list[list[tuple]] = []
        while left:
            want = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            left -= want
            own = []
            while want:
                key, start, length = pieces.pop(0)
                take = min(want, length)
                own.append((key, start, take))
                want -= take
                if take < length:
                    pieces.insert(0, (key, start + take, length - take))
            done.append(own)
        self.room, self.held = [], {}
        return done


def pack_documents(
    docs: DataFrame, vocabulary_path: str, end_id: int, size: int = 1024, open_windows: int = 64
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (unsigned 32-bit), doc_tokens,
    sequence_id, offset.

    Every task packs the rows it reads, holding at most `open_windows` windows; nothing is
    shuffled. Each id lies in one piece, offsets have no gaps, and every sequence has `size` ids
    or a power of two. A null text is empty and has the end id only; a null doc_id is kept;
    repeated rows are packed each. An empty table gives no rows.
    """
    width = 4

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary_path, width)
        end = end_id.to_bytes(width, "little")
        packer = Packer(size, open_windows)
        first = TaskContext.get().partitionId() << _PART_BITS
        sequences = 0
        held: dict[int, list] = {}  # row -> [doc_id, its last ids, where they start, all tokens, open]
        row = 0

        def rows(done: list[list[tuple]]) -> list[tuple]:
            nonlocal sequences
            out = []
            for own in done:
                offset = 0
                for key, start, length in own:
                    document = held[key]
                    at = (start - document[2]) * width
                    ids = document[1][at : at + length * width]
                    out.append((document[0], start, length, ids, document[3], first + sequences, offset))
                    offset += length
                    document[4] -= length
                    if not document[4]:
                        del held[key]
                sequences += 1
            return out

        def frame(found: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(found, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in text_blocks(batches):
            found: list[tuple] = []
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            for name, ids in zip(batch["doc_id"].tolist(), encode.encode(texts)):
                ids += end
                tokens = len(ids) // width
                document = held[row] = [name, ids, 0, tokens, tokens]
                found += rows(packer.place(row, tokens))
                if document[4]:  # what is still open is the end of the document
                    document[2] = tokens - document[4]
                    document[1] = ids[document[2] * width :]
                row += 1
            if found:
                yield frame(found)
        if found := rows(packer.finish()):
            yield frame(found)

    known = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id")
    pieces = docs.select(known, "text").mapInPandas(pack, _PIECES)
    return pieces.withColumn("doc_id", F.expr(f"nullif(doc_id, {_NULL_ID})"))


def piece_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a crc32 in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
