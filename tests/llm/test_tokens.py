"""The piece cache of the encoder."""

from __future__ import annotations

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidelog.llm import tokens
from tidelog.llm.tokens import Encoder, vocabulary


def _words(count: int, seed: int = 3) -> list[str]:
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzéüñ"))
    return ["".join(rng.choice(letters, n)) for n in rng.integers(5, 14, count)]


def _fresh(name: str, texts: list[str]) -> list[bytes]:
    library = Tokenizer.from_file(vocabulary(name))
    library.encode_special_tokens = True
    return [np.array(e.ids, dtype="<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


def test_words_seen_once_are_remembered_in_few_bytes():
    own = Encoder(vocabulary("byte_bpe_50k.json"), 4, cache_bytes=8 << 20)
    known, calls = own._word, []
    own._word = lambda letters: calls.append(letters) or known(letters)
    words = _words(120_000)
    texts = [" ".join(["x", *words[at : at + 500]]) for at in range(0, len(words), 500)]
    first = own.encode(texts)
    calls.clear()
    assert own.encode(texts) == first
    assert not calls  # an entry has about 60 bytes, so all words are known


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_equal_hashes_are_no_equal_pieces(name, monkeypatch):
    texts = ["a bc d\nef, g", "", "x", " y  z", "bc a", *(" ".join(_words(50, k)) for k in range(5))]
    monkeypatch.setattr(tokens, "mix", lambda h: np.zeros_like(h))
    assert Encoder(vocabulary(name), 4).encode(texts) == _fresh(name, texts)
    monkeypatch.setattr(tokens, "mix", lambda h: h % np.uint64(7))
    assert Encoder(vocabulary(name), 4).encode(texts) == _fresh(name, texts)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_of_any_length_and_sign(name):
    long = "ab" * 40
    texts = [f"q {long} {long}c {long}d", f"q {long}d \x00 \x00\x00 ", "q \x00a a\x00 a", "日本 語\n日本 語, 日本", "a\n\nb c", "q " + "é" * 3000]
    own = Encoder(vocabulary(name), 4, cache_bytes=1 << 12)
    for text in texts * 2:
        assert own.encode([text]) == _fresh(name, [text])
    own.encode(["a b"])
    assert own.young_bytes < 1 << 12
