"""Token ids of whole texts, with a cache of the pieces between single spaces."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from tidelog.llm.common import mix, one_thread

_ODD_SPACE = re.compile(r" \s|[^\S ] |^ | $")
_LATIN = 0x250  # code points below: composed already, lower case does not depend on neighbours
_LONGER = {c for c in map(chr, range(_LATIN)) if len(c.lower()) > 1}  # U+0130: its lower case holds a mark
_MARKS = ".,;:!?%$#&*|"  # runs of these are one unit after a word
_RARE_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_LONE_SPACE = re.compile(r"\S(?= \S)")
_CACHE_BYTES = 48 << 20  # what a worker remembers of pieces, about
_PART = 1 << 18  # characters of a text that are worked on without a cut
_GROUP = 1 << 20  # characters of texts whose pieces are looked up together
_PLACES = 64  # places of a piece that have a weight of their own in its hash
with np.errstate(over="ignore"):
    _WEIGHTS = np.cumprod(np.full(_PLACES, 0x9E3779B97F4A7C15, dtype=np.uint64))


def _is_even(text: str) -> bool:
    """White space is single blanks and line breaks between words, and nothing else."""
    if text[:1] in (" ", "\n") or text[-1:] in (" ", "\n"):
        return False
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    return not any(c in text for c in _RARE_SPACES)


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for
    themselves, the others follow from U+0100 on in ascending order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _narrow(largest: int) -> type:
    """A kind of place for at most `largest`, of 4 bytes if they do."""
    return np.int32 if largest < 1 << 31 else np.int64


def _spans(start: np.ndarray, size: np.ndarray, limit: int) -> np.ndarray:
    """The places start, start + 1, ... (below `limit`) of runs of `size`, one run after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    kind = _narrow(max(limit, total))
    places = np.arange(total, dtype=kind)
    places += np.repeat((start - ends + size).astype(kind), size)
    return places


def _offsets(ends: np.ndarray, sizes: list[int]) -> np.ndarray:
    """`ends` with more runs of `sizes` behind the last."""
    return np.concatenate((ends, ends[-1] + np.cumsum(sizes, dtype=np.int64)))


class Pieces:
    """What is known of pieces, in flat arrays: bytes and ids of all of them, found by sorted hashes.

    A hash only proposes an entry, whoever asks compares the bytes. `clock` tells when an entry
    was asked for; `forget` keeps the half asked for last.
    """

    def __init__(self, dtype: np.dtype) -> None:
        self.dtype = dtype
        self.clock = 0
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)  # ascending
        self.entries = np.zeros(0, dtype=np.int32)  # in the order of the hashes
        self.asked = np.zeros(0, dtype=np.int32)
        self.text_at = np.zeros(1, dtype=np.int64)
        self.text = np.zeros(0, dtype=np.uint8)
        self.ids_at = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=self.dtype)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.hashes, self.entries, self.asked, self.text_at, self.text, self.ids_at, self.ids))

    def missing(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the ascending `hashes` have no entry."""
        if not len(self.hashes):
            return np.arange(len(hashes))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.flatnonzero(self.hashes[at] != hashes)

    def add(self, hashes: np.ndarray, texts: list[bytes], ids: list[bytes]) -> None:
        at = np.searchsorted(self.hashes, hashes)
        known = len(self.asked)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.entries = np.insert(self.entries, at, np.arange(known, known + len(hashes), dtype=np.int32))
        self.asked = np.concatenate((self.asked, np.full(len(hashes), self.clock, dtype=np.int32)))
        self.text_at = _offsets(self.text_at, [len(x) for x in texts])
        self.text = np.concatenate((self.text, np.frombuffer(b"".join(texts), dtype=np.uint8)))
        self.ids_at = _offsets(self.ids_at, [len(x) // self.dtype.itemsize for x in ids])
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(ids), dtype=self.dtype)))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        entries = self.entries[np.searchsorted(self.hashes, hashes)]
        self.asked[entries] = self.clock
        return entries

    def forget(self, least: int) -> None:
        """Drops what was not asked for lately, and all if the rest has more than `least` bytes."""
        keep = self.asked > np.partition(self.asked, len(self.asked) // 2)[len(self.asked) // 2]
        stays = keep[self.entries]
        self.hashes = self.hashes[stays]
        self.entries = (np.cumsum(keep, dtype=np.int32) - 1)[self.entries[stays]]
        self.asked = self.asked[keep]
        for at, flat in (("text_at", "text"), ("ids_at", "ids")):
            size = np.diff(getattr(self, at))
            setattr(self, flat, getattr(self, flat)[np.repeat(keep, size)])  # a byte a place, no list of places
            setattr(self, at, np.concatenate(([0], np.cumsum(size[keep]))))
        if self.nbytes > least:
            self.clear()


class Encoder:
    """Ids as little-endian bytes of fixed width, equal to encoding each text by itself.

    Neither pre-tokenizer used here joins what a single space separates: the byte-level one
    gives a space to the word after it, the other drops it. A line break alone is a unit. A piece therefore has the same ids
    in every text, and a worker need not encode it again. A new piece that is one word of Latin letters,
    with or without marks at its end, goes straight to the library's model; all others go
    through its whole chain, also words with a letter whose lower case is more than one
    character. Strings of special tokens in a text are ordinary text. Texts with other runs of
    white space are encoded by themselves where the byte-level rule could look across a space.

    The pieces of a group of texts are hashed and looked up together; every piece is then compared with
    the bytes of the entry found, and a group where one differs is left to the library. What is
    remembered has `cache_bytes`; when it is full the half asked for last stays. Texts are
    worked on in parts and groups of a bounded length, so memory follows neither a text nor a batch.
    """

    def __init__(self, path: str, width: int = 4, cache_bytes: int = _CACHE_BYTES) -> None:
        one_thread()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.keeps_space = self.tokenizer.normalizer is None
        self.dtype = np.dtype({2: "<u2", 4: "<u4"}[width])
        size = self.tokenizer.get_vocab_size()
        if size > 2 ** (8 * width):
            raise ValueError("ids do not fit into the width asked for")
        self.cache_bytes = cache_bytes
        self.model = self.tokenizer.model
        letters = _byte_letters()
        latin = [chr(c) if self.keeps_space else chr(c).lower() for c in range(_LATIN)]
        self.letters = {c: "".join(letters[b] for b in s.encode()) for c, s in enumerate(latin)}
        self.lead = letters[0x20] if self.keeps_space else ""
        self.pieces = Pieces(np.dtype("<u2" if size <= 1 << 16 else "<u4"))
        self.packed = [n.to_bytes(self.pieces.dtype.itemsize, "little") for n in range(size)]
        self.line_break = self._chain(["\n"], self.pieces.dtype)[0]

    @property
    def young_bytes(self) -> int:
        return self.pieces.nbytes

    def _chain(self, texts: list[str], dtype: np.dtype) -> list[bytes]:
        if not texts:
            return []
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=dtype).tobytes() for e in found]

    def _word(self, letters: str) -> bytes:
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(letters)])

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """The ids of every piece after a space, or with the line break before it."""
        letters, lead, word, dtype = self.letters, self.lead, self._word, self.pieces.dtype
        marks = {"": b""}
        known: dict[str, bytes] = {}
        out: list[bytes] = []
        others = []
        for n, piece in enumerate(pieces):
            bare = piece.rstrip(_MARKS)
            body = bare.removeprefix("\n")
            if not body.isalpha() or ord(max(body)) >= _LATIN or not _LONGER.isdisjoint(body):
                others.append(n)
                out.append(b"")
                continue
            ids = known.get(bare)
            if ids is None:
                begin = lead if body is bare else ""
                ids = word(begin + body.translate(letters))
                if body is not bare:
                    ids = self.line_break + ids
                known[bare] = ids
            mark = piece[len(bare) :]
            if mark not in marks:
                marks[mark] = self._chain([mark], dtype)[0]
            out.append(ids + marks[mark])
        left = [pieces[n] for n in others]
        for n, ids in zip(others, self._chain([p if p[:1] == "\n" else " " + p for p in left], dtype)):
            out[n] = ids
        return out

    def _parts(self, text: str) -> list[str]:
        """A long text in parts that begin with a lone space, where no id crosses."""
        if len(text) <= _PART:
            return [text]
        parts, begin = [], 0
        while len(text) - begin > _PART and (cut := _LONE_SPACE.search(text, begin + _PART)):
            parts.append(text[begin : cut.start() + 1])
            begin = cut.start() + 1
        return [*parts, text[begin:]]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        group: list[tuple[int, str, bool]] = []  # text, part of it, whether it is the first
        size = 0
        for k, text in enumerate(texts):
            for n, part in enumerate(self._parts(text)):
                group.append((k, part, n == 0))
                size += len(part)
                if size > _GROUP:
                    self._encode_group(group, out)
                    group, size = [], 0
        self._encode_group(group, out)
        return [own[0] if len(own) == 1 else b"".join(own) for own in out]

    def _encode_group(self, group: list[tuple[int, str, bool]], out: list[list[bytes]]) -> None:
        if self.pieces.nbytes > self.cache_bytes:
            self.pieces.forget(self.cache_bytes // 2)
        heads, rests, plain = [], [], []  # plain: what has pieces; the library gets the others as they are
        for _, text, first in group:
            if not self.keeps_space:  # white space only separates
                text = text.replace("\n", " ")
            elif _is_even(text if first else text[1:]):
                text = text.replace("\n", " \n")
            elif _ODD_SPACE.search(text, 0 if first else 1):
                plain.append(False)
                continue
            head, gap, rest = text.partition(" ")
            heads.append(head)
            rests.append(gap + rest)
            plain.append(True)
        found = self._looked_up(rests)
        if found is None:
            plain = [False] * len(group)
        whole = iter(self._chain([t for (_, t, _), p in zip(group, plain) if not p], self.dtype))
        begins = iter(self._chain(heads, self.dtype) if found is not None else [])
        ids = iter(found or [])
        for (k, _, _), p in zip(group, plain):
            out[k].append(next(begins) + next(ids) if p else next(whole))

    def _looked_up(self, rests: list[str]) -> list[bytes] | None:
        """The ids of texts that are empty or begin with a space, cut before every space; None where the
        hashes of two pieces agree."""
        data = "".join(rests).encode()
        if not data:
            return [b""] * len(rests)
        known = self.pieces
        known.clock += 1
        raw = np.frombuffer(data, dtype=np.uint8)
        begin = np.flatnonzero(raw == 0x20)
        size = np.diff(begin, append=len(raw))
        kind = _narrow(len(raw))
        place = np.arange(len(raw), dtype=kind)
        place -= np.repeat(begin.astype(kind), size)
        weighed = _WEIGHTS.take(place, mode="clip")
        weighed *= raw
        hashes = mix(np.add.reduceat(weighed, begin))
        del weighed
        hashes, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        new = known.missing(hashes)
        if len(new):
            at = where[new]
            texts = [data[b : b + n] for b, n in zip(begin[at].tolist(), size[at].tolist())]
            known.add(hashes[new], texts, self._learn([t[1:].decode() for t in texts]))
        entry = known.find(hashes)[which]
        text_at = known.text_at[entry]
        if not np.array_equal(known.text_at[entry + 1] - text_at, size):
            return None
        kind = _narrow(len(known.text))
        place = place.astype(kind, copy=False)
        place += np.repeat(text_at.astype(kind), size)
        if not np.array_equal(known.text[place], raw):
            return None
        del place
        ids_at = known.ids_at[entry]
        counts = known.ids_at[entry + 1] - ids_at
        ids = known.ids[_spans(ids_at, counts, len(known.ids))].astype(self.dtype, copy=False).tobytes()
        ends = np.concatenate(([0], np.cumsum(counts))) * self.dtype.itemsize
        ends = ends[np.cumsum([0, *[rest.count(" ") for rest in rests]])].tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:])]


@lru_cache(maxsize=2)
def encoder(path: str, width: int = 4) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path, width)


def vocabulary(name: str) -> str:
    """Where the installed public tokenizer file is; every executor has it at its own path."""
    import public_tokenizers

    return public_tokenizers.path(name)
