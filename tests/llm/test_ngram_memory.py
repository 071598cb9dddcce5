"""Prefixes are listed in bounded memory."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd

from tidelog.llm import ngram_join


def test_prefixes_are_listed_in_bounded_memory(spark, monkeypatch):
    sets = spark.createDataFrame([], "node long, n int, tokens binary")
    functions = {}
    known = type(sets).mapInPandas

    def kept(self, function, *args, **named):
        functions[function.__name__] = function
        return known(self, function, *args, **named)

    monkeypatch.setattr(type(sets), "mapInPandas", kept)
    ngram_join.prefix_entries(sets)
    rng = np.random.default_rng(4)
    tokens = [rng.integers(0, 2**60, 804) for _ in range(1000)]
    counts = [np.sort(rng.integers(2, 9, 804)) for _ in range(1000)]
    batch = pd.DataFrame({"node": np.arange(1000), "n": 4000, "single": 5, "counts": counts, "tokens": tokens})
    seen: dict[int, int] = {}
    tracemalloc.start()
    for found in functions["choose"](iter([batch])):
        for node, own in found.groupby("node"):
            want = own["want"].iloc[0]
            size = ngram_join.missing(4000) + want - 5
            assert own["token"].tolist() == tokens[node][:size].tolist()
            assert own["place"].tolist() == list(range(5, 5 + size)) and set(own["n"]) == {4000}
            seen[node] = size
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(seen) == 1000
    assert peak < 60e6
