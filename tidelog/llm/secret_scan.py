"""Secrets in texts and in what the texts encode, layer by layer."""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import blocks, give_back

KINDS = ("assign", "access", "hex")
_NULL_ID = -(2**63) + 1  # inside tasks, for rows without doc_id
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # maximal runs, so the length can be asked for at once
_HEX = re.compile(r"[0-9a-f]{24,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#(\d{1,7});|&#x([0-9A-Fa-f]{1,6});")
_ESCAPED_BYTES = (  # stretches that hold escaped bytes, and their units of one byte each
    ("%", re.compile(r"[!-$&-~]*(?:%[0-9A-Fa-f]{2}[!-$&-~]*)+"), re.compile(r"%([0-9A-Fa-f]{2})|()()(.)")),
    (
        "\\x",
        re.compile(r"(?:\\x[0-9A-Fa-f]{2}|\\[^xuU\n]|[\x20-\[\]-~])+"),
        re.compile(r"\\x([0-9A-Fa-f]{2})|\\([0-7]{1,3})|\\(.)|(.)"),
    ),
)
_SIGNS = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13}
_A, _X, _BREAK = r"[A-Za-z0-9+/_-]", r"[0-9a-fA-F]", r"(?:\r?\n|\\r\\n|\\n)[\x20\t>]*"
_BASE64 = re.compile(rf"{_A}{{16,}}={{0,2}}")
_BASE64_LINES = re.compile(rf"(?<!{_A}){_A}{{4,}}+(?:{_BREAK}{_A}++)+={{0,2}}")
_BASE64_PART = re.compile(rf"(?:{_BREAK})?({_A}+)")
_HEX_BYTES = re.compile(rf"{_X}{{24,}}")
_HEX_LINES = re.compile(rf"(?<!{_X}){_X}{{4,}}+(?:{_BREAK}{_X}++)+")
_HEX_PART = re.compile(rf"(?:{_BREAK})?({_X}+)")
_PLAIN = rb"[\x09-\x0d\x20-\x7e]"
_STRETCHES = (  # 12 bytes are the shortest find; finds and what encodes them are ASCII
    re.compile(_PLAIN + rb"{12,}"),
    re.compile(rb"(?:" + _PLAIN + rb"\0){12,}"),
    re.compile(rb"(?:\0" + _PLAIN + rb"){12,}"),
)
_PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|[\x08\x18\x28\x38\x48\x58\x68\x78](?=.)", re.S)
_STEP = 256  # packed bytes taken at once
_BLOCK = 4 << 20  # bytes unpacked at once
_OVERLAP = 64 << 10  # bytes that neighbouring blocks share


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """The base spans of one layer: start, end (exclusive), kind."""
    spans = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return spans


class _Layer:
    """A decoded text and where each of its characters stands in the original.

    Either a list of (start, end) per character, or one range for all of them.
    """

    __slots__ = ("text", "places", "whole")

    def __init__(self, text: str, places: list[tuple[int, int]] | None, whole: tuple[int, int] | None) -> None:
        self.text, self.places, self.whole = text, places, whole

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.whole is not None:
            return self.whole
        if self.places is None:
            return start, end
        return self.places[start][0], self.places[end - 1][1]


def _rewritten(layer: _Layer, pattern: re.Pattern, decode) -> _Layer | None:
    """The layer with every match replaced by what it stands for; None if nothing changed."""
    text, parts, places, last, changed = layer.text, [], [], 0, False
    keep = layer.whole is None
    for m in pattern.finditer(text):
        new = decode(m)
        if new is None:
            continue
        changed = True
        parts += [text[last : m.start()], new]
        if keep:
            places += [layer.span(k, k + 1) for k in range(last, m.start())]
            places += [layer.span(m.start(), m.end())] * len(new)
        last = m.end()
    if not changed:
        return None
    parts.append(text[last:])
    if keep:
        places += [layer.span(k, k + 1) for k in range(last, len(text))]
    return _Layer("".join(parts), places if keep else None, layer.whole)


def _percent(m: re.Match) -> str:
    return bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace")


def _escape(m: re.Match) -> str | None:
    value = int(m[1] or m[2] or m[3] or m[5] or "0", 16) if not m[4] else int(m[4])
    return chr(value) if value < 0x110000 and not 0xD800 <= value < 0xE000 else None


def _unpacker(data: bytes, at: int):
    """What makes a worker for the compressed stream that may begin here, or None."""
    import zstandard

    if data[at] == 0x1F:
        return lambda: zlib.decompressobj(31)
    if data.startswith(b"BZh", at):
        return bz2.BZ2Decompressor
    if data[at] == 0xFD:
        return lzma.LZMADecompressor
    if data.startswith(b"\x28\xb5\x2f\xfd", at):
        return lambda: zstandard.ZstdDecompressor().decompressobj()
    return zlib.decompressobj if (data[at] * 256 + data[at + 1]) % 31 == 0 else None


def _stream(make, data: bytes, at: int) -> Iterator[tuple[bytes, int]]:
    """Pieces of what a stream holds, each with the end of the stream if it is reached, else -1.

    A broken stream gives all that comes before the broken byte, a cut one all that is there;
    streams of one kind that follow each other are read on.
    """
    import zstandard

    broken = (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError, zstandard.ZstdError)
    mark, first, worker = data[at : at + 3], at, make()
    while at < len(data):
        try:
            piece = worker.decompress(data[at : at + _STEP])
        except broken:
            try:
                worker = make()
                for k in range(first, at, _STEP):
                    worker.decompress(data[k : min(k + _STEP, at)])
                for k in range(at, min(at + _STEP, len(data))):
                    yield worker.decompress(data[k : k + 1]), -1
            except broken:
                pass
            return
        at = min(at + _STEP, len(data))
        if not worker.eof:
            yield piece, -1
            continue
        at -= len(worker.unused_data)
        yield piece, at
        if data[at : at + 3] != mark:
            return
        first, worker = at, make()


def _blocks(make, data: bytes, at: int) -> Iterator[bytes]:
    """What a stream holds, in overlapping blocks."""
    tail, held, size = b"", [], 0
    for piece, _ in _stream(make, data, at):
        held.append(piece)
        size += len(piece)
        if size >= _BLOCK:
            block = tail + b"".join(held)
            yield block
            tail, held, size = block[-_OVERLAP:], [], 0
    if size:
        yield tail + b"".join(held)


def _packed(data: bytes) -> Iterator[tuple[int, int, Iterator[bytes]]]:
    """Compressed streams anywhere in the bytes: start, end, blocks of what they hold."""
    last = 0
    for m in _PACKED.finditer(data):
        if m.start() < last or (make := _unpacker(data, m.start())) is None:
            continue
        size, end = 0, -1
        for piece, reached in _stream(make, data, m.start()):
            size, end = size + len(piece), max(end, reached)
        if size:
            last = max(last, end)
            yield m.start(), end if end >= 0 else len(data), _blocks(make, data, m.start())


def _stretches(data: bytes, patterns=_STRETCHES) -> Iterator[tuple[str, int, int]]:
    """ASCII text anywhere in the bytes, of one or two bytes (UTF-16) a character."""
    for pattern in patterns:
        for m in pattern.finditer(data):
            yield m[0].replace(b"\0", b"").decode("ascii"), m.start(), m.end()


def _texts(blocks: Iterator[bytes]) -> Iterator[str]:
    """Texts of unpacked blocks and of packed data inside them, each block once. Packed data inside
    a block is followed to the end of the block."""
    work, seen = [blocks], set()
    while work:
        block = next(work[-1], None)
        if block is None:
            work.pop()
            continue
        mark = hashlib.blake2b(block, digest_size=16).digest()
        if mark in seen:
            continue
        seen.add(mark)
        yield block.decode("utf-8", "replace")
        for text, *_ in _stretches(block, _STRETCHES[1:]):
            yield text
        work += [inner for *_, inner in _packed(block)]


def _readable(data: bytes) -> str | None:
    """Bytes as text if they are UTF-8 without control characters."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and not re.search(r"[\x00-\x08\x0e-\x1f\x7f]", text) else None


def _base64(body: str, at: int) -> bytes:
    part = body[at:].replace("-", "+").replace("_", "/")
    part = part[: len(part) - (len(part) % 4 == 1)]
    return base64.b64decode(part + "=" * (-len(part) % 4))


def _hex(body: str, at: int) -> bytes:
    return bytes.fromhex(body[at : at + (len(body) - at) // 2 * 2])


# Runs of one line, runs over lines, parts of those; decoder, its alignments, letters and bytes of a unit.
_CODES = (
    (_BASE64, _BASE64_LINES, _BASE64_PART, _base64, 4, 4, 3),
    (_HEX_BYTES, _HEX_LINES, _HEX_PART, _hex, 2, 2, 1),
)


def _coded(layer: _Layer, code: tuple) -> Iterator[_Layer]:
    """What base64 or hex runs hold, over line ends and at every alignment.

    A run over several lines counts only for what really crosses a line end (four bytes on both
    sides, or packed data that goes on); all else is found in its line, unless the line belongs
    to such a longer range.
    """
    line, lines, part, decode, alignments, letters, size = code
    text, taken = layer.text, []
    runs = []
    if "\n" in text or "\\n" in text:
        for m in lines.finditer(text):
            at, ends = [], []
            for x in part.finditer(text, m.start(), m.end()):
                at += range(x.start(1), x.end(1))
                ends.append(len(at))
            if len(at) >= 12 * letters // size:
                runs.append((at, ends[:-1], m.end()))
    for at, ends, stop in runs:
        yield from _run(layer, "".join([text[k] for k in at]), at, ends, stop, taken, decode, alignments, letters, size)
    for m in line.finditer(text):
        if not any(a <= m.start() and m.end() <= b for a, b in taken):
            body = m[0].rstrip("=")
            at = range(m.start(), m.start() + len(body))
            yield from _run(layer, body, at, [], m.end(), [], decode, alignments, letters, size)


def _run(layer, body, at, ends, stop, taken, decode, alignments, letters, size) -> Iterator[_Layer]:
    for offset in range(alignments):
        data = decode(body, offset)

        def place(a: int, b: int) -> tuple[int, int]:
            """The letters that hold bytes a to b; the padding belongs to the last byte."""
            last = offset + -(-b * letters // size)
            end = stop if b == len(data) and last + (size > 1) >= len(body) else at[min(last, len(body)) - 1] + 1
            return at[offset + a * letters // size], end

        def crosses(a: int, b: int, least: int) -> bool:
            edges = [(k - offset) * size / letters for k in ends]
            return not ends or any(a + least <= k <= b - least for k in edges)

        plain = _readable(data)
        if plain is not None and offset == 0:
            if crosses(0, len(data), 0):
                where = place(0, len(data))
                taken.append(where)
                yield _Layer(plain, None, layer.span(*where))
                return
        for inner, a, b in _stretches(data):
            if crosses(a, b, 4):
                taken.append(place(a, b))
                yield _Layer(inner, None, layer.span(*place(a, b)))
        for a, b, blocks in _packed(data):
            if crosses(a, b, 1):
                where = place(a, b) if a or offset or ends else (at[0], stop)
                if data[a] & 0x0F != 8:  # zlib's mark is too short to be sure
                    taken.append(where)
                for inner in _texts(blocks):
                    yield _Layer(inner, None, layer.span(*where))


def _escaped(layer: _Layer) -> Iterator[_Layer]:
    """What percent- or backslash-escaped bytes hold that are packed or UTF-16."""
    for sign, stretch, unit in _ESCAPED_BYTES:
        if sign not in layer.text:
            continue
        for m in stretch.finditer(layer.text):
            if sign not in m[0]:
                continue
            units = list(unit.finditer(layer.text, m.start(), m.end()))
            data = bytes(
                int(u[1], 16) if u[1] else int(u[2], 8) & 255 if u[2] else _SIGNS.get(u[3], ord(u[3]) & 255) if u[3] else ord(u[4])
                for u in units
            )
            if _readable(data) is not None:
                continue
            forms = [data]
            if sign == "%" and "+" in m[0]:  # forms write a blank as +
                forms.append(bytes(32 if u[0] == "+" else x for u, x in zip(units, data)))
            for form in forms:
                for inner, a, b in _stretches(form, _STRETCHES[1:]):
                    yield _Layer(inner, None, layer.span(units[a].start(), units[b - 1].end()))
                for a, b, blocks in _packed(form):
                    for inner in _texts(blocks):
                        yield _Layer(inner, None, layer.span(units[a].start(), units[b - 1].end()))


def _inner(layer: _Layer) -> Iterator[_Layer]:
    """What one layer encodes: one decoding step in every way that changes it."""
    text = layer.text
    if "%" in text and (new := _rewritten(layer, _PERCENT, _percent)):
        yield new
    if ("\\" in text or "&#" in text) and (new := _rewritten(layer, _UNICODE, _escape)):
        yield new
    yield from _escaped(layer)
    for code in _CODES:
        yield from _coded(layer, code)


def scan_text(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans: the base ones and those of every inner layer.

    A worklist unwraps URL escapes, Unicode escapes, base64, hex bytes (both over line ends and glued
    to letters of their own alphabet) and compressed data, also cut or broken, until nothing new
    comes out. A layer with the same text at the same place is taken once, which
    ends cycles; apart from that every step makes a text shorter, or unpacks it. A find in an
    inner layer is mapped to the range of the original that encodes it.
    """
    base = find_spans(text)
    spans = set(base)
    seen: set[bytes] = set()
    work = [_Layer(text, None, None)]
    while work:
        for new in _inner(work.pop()):
            mark = hashlib.blake2b(f"{new.whole}\0{new.text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
            if mark in seen:
                continue
            seen.add(mark)
            spans.update((*new.span(a, b), kind) for a, b, kind in find_spans(new.text))
            work.append(new)
    return ordered(base), ordered(spans)


def ordered(spans) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _without(text: str, spans: list[tuple[int, int, str]], mask: str) -> str:
    """The text with each stretch of overlapping spans replaced by the mask."""
    out, last = [], 0
    for a, b, _ in spans:
        if a >= last:
            out += [text[last:a], mask]
        last = max(last, b)
    return "".join([*out, text[last:]])


def scan_secrets(docs: DataFrame, mask: str = "***") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base, spans, redacted for every row.

    `base` and `spans` list kind:start:end (code points of the original, end exclusive) by start,
    then kind; `redacted` is the text with all spans masked. A null text counts as empty and its
    `redacted` stays null. Null ids and repeated rows are kept and scanned each. Nothing is
    shuffled; unpacked data is looked at in blocks, so memory does not depend on how far
    something expands.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in blocks(batches):
            rows = []
            for name, text in zip(batch["doc_id"].tolist(), batch["text"]):
                known = isinstance(text, str)
                base, spans = scan_text(text) if known else ([], [])
                count = [sum(kind == k for *_, kind in base) for k in KINDS]
                rows.append((name, *count, _joined(base), _joined(spans), _without(text, spans, mask) if known else None))
            yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base", "spans", "redacted"])

    known = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id")
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string, redacted string"
    found = docs.select(known, "text").mapInPandas(scan, schema)
    return found.withColumn("doc_id", F.expr(f"nullif(doc_id, {_NULL_ID})"))


def redacted_column(text: Column, mask: str = "***") -> Column:
    """`text` with all spans masked; null stays null."""

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        masked = texts.map(lambda t: _without(t, scan_text(t)[1], mask) if isinstance(t, str) else None)
        give_back()
        return masked

    return redact(text)


def base_digest(base: Column) -> Column:
    return F.sha2(base.cast("binary"), 256)
