"""What a Python worker holds between batches and while its piece cache forgets."""

from __future__ import annotations

import gc
import tracemalloc
import weakref

import numpy as np
import pandas as pd

from tidelog.llm import common
from tidelog.llm.tokens import Encoder, Pieces, vocabulary


def test_a_batch_goes_with_its_last_block():
    seen = []

    def batches():
        for n in range(3):
            batch = pd.DataFrame({"doc_id": range(4), "text": [f"{n} é", None, "", f"{n}" * 50]})
            seen.append(weakref.ref(batch["text"]))
            yield batch
            del batch

    gc.collect()
    gc.disable()
    try:
        found = [block["text"].tolist() for block in common.text_blocks(batches(), 100)]
        assert [r() for r in seen] == [None] * 3
    finally:
        gc.enable()
    assert [len(x) for x in found] == [2, 2] * 3
    assert [t for x in found for t in x] == [t for n in range(3) for t in (f"{n} é", None, "", f"{n}" * 50)]


def test_forgetting_takes_less_than_what_is_known():
    known, rng = Pieces(np.dtype("<u2")), np.random.default_rng(5)
    for clock in (1, 2):
        known.clock = clock
        hashes = np.sort(rng.choice(2**40, 60_000, replace=False).astype(np.uint64) * np.uint64(2) + np.uint64(clock - 1))
        known.add(hashes, [int(h).to_bytes(8, "little") * 10 for h in hashes], [int(h).to_bytes(8, "little") * 2 for h in hashes])
    kept, before = hashes, known.nbytes
    known.asked[:60_001] = 1  # the half asked for last is less than half
    tracemalloc.start()
    known.forget(before)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < before * 1.5
    assert known.nbytes < before * 0.6
    again = known.find(kept[np.isin(kept, known.hashes)])
    assert len(again) >= 59_999
    for entry, value in zip(again[::1000], kept[np.isin(kept, known.hashes)][::1000]):
        assert known.text[known.text_at[entry] : known.text_at[entry + 1]].tobytes() == int(value).to_bytes(8, "little") * 10
        assert known.ids[known.ids_at[entry] : known.ids_at[entry + 1]].tobytes() == int(value).to_bytes(8, "little") * 2


def test_a_group_is_looked_up_in_few_bytes_a_character():
    rng = np.random.default_rng(6)
    words = ["".join(x) for x in rng.choice(list("abcdefgh"), (2000, 9))]
    text = "x " + " ".join(rng.choice(words, 100_000))
    own = Encoder(vocabulary("byte_bpe_50k.json"), 4)
    first = own.encode([text[:250_000]] * 4)
    tracemalloc.start()
    assert own.encode([text[:250_000]] * 4) == first
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * 1_000_000
