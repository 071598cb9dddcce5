"""Passages that documents repeat from documents with smaller ids.

A window of `WORDS` words is removed where its words also start in a document with a smaller id.
Windows are dealt to shards by content: a window belongs to its minimizer, the smallest hash of
its runs of five words. Neighbouring windows with one minimizer travel together as a run. Only
minimizers that two documents have can hold a repeated window, so

1. the minimizers of all documents are counted, and each document learns its shared ones; very
   frequent ones, found in a bounded sample, are known to be shared and are spread, not gathered;
2. every distinct run with a shared minimizer is sent by its first document to the shard of the
   minimizer;
3. each shard builds a compressed FM-index over its distinct runs, streams them through it by
   backward search, and reports for every window the smallest document in its interval;
4. the answers go back to the documents, which drop the covered words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import blocks, mix, sequence_hash, word_hashes, written
from tidelog.llm.fm_index import FmIndex

WORDS = 13
_SEED = 5  # words of a minimizer
_BYTES = 5  # bytes of a word's hash that a shard sees
_SHORT = (1 << 48) - 1  # of a minimizer, when counted: one shared by chance only costs a look
_SPREAD = 997  # parts of the rows of a very frequent minimizer
_SAMPLE = 20_000  # documents looked at to find minimizers that very many have
_OFTEN = 40
_SHARD = 2_000_000  # words in one index, about


class Runs:
    """Runs of neighbouring windows with one minimizer, of a list of texts."""

    def __init__(self, texts: list) -> None:
        self.words, offsets = word_hashes(texts)
        count = max(0, len(self.words) - WORDS + 1)
        seeds = sequence_hash(self.words, _SEED)
        least = seeds[:count].copy()
        for k in range(1, WORDS - _SEED + 1):
            np.minimum(least, seeds[k : k + count], out=least)
        document = np.repeat(np.arange(len(texts)), np.diff(offsets))[:count]
        inside = np.arange(count) + WORDS <= offsets[document + 1] if count else np.zeros(0, dtype=bool)
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | (least[1:] != least[:-1]) | (document[1:] != document[:-1])
        self.start = np.flatnonzero(begins)  # first window of each run, among all words
        number = np.cumsum(begins)[inside] - 1
        self.windows = np.bincount(number, minlength=len(self.start)).astype(np.int64)
        self.minimizer = least[self.start].view(np.int64)
        self.document = document[self.start]
        self.place = self.start - offsets[self.document]

    def hashes(self, chosen: np.ndarray) -> np.ndarray:
        """Hash of all words of each chosen run."""
        length = self.windows[chosen] + WORDS - 1
        begin, out = self.start[chosen], np.zeros(len(chosen), dtype=np.uint64)
        for size in np.unique(length).tolist():
            own = np.flatnonzero(length == size)
            value = np.full(len(own), size, dtype=np.uint64)
            for k in range(size):
                value = mix(value * np.uint64(0x9E3779B97F4A7C15) + self.words[begin[own] + k])
            out[own] = value
        return out.view(np.int64)

    def packed(self, run: int) -> bytes:
        """The words of a run, `_BYTES` bytes each."""
        begin = self.start[run]
        words = self.words[begin : begin + self.windows[run] + WORDS - 1]
        return words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES].tobytes()


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in blocks(batches):
        runs = Runs(part["text"].tolist())
        yield pd.DataFrame(
            {
                "minimizer": runs.minimizer & _SHORT,
                "doc_id": part["doc_id"].to_numpy()[runs.document],
                "place": runs.place.astype(np.int32),
            }
        )


def _chosen(part: pd.DataFrame, runs: Runs) -> np.ndarray:
    """Runs that begin at one of the listed places of their document."""
    first = np.searchsorted(runs.document, np.arange(len(part) + 1))
    picked = []
    for k, places in enumerate(part["places"]):
        own = np.arange(first[k], first[k + 1])
        picked.append(own[np.isin(runs.place[own], places)])
    return np.concatenate(picked) if picked else np.zeros(0, dtype=np.int64)


def _occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The runs of each document at its listed places."""
    for part in blocks(batches):
        runs = Runs(part["text"].tolist())
        chosen = _chosen(part, runs)
        document = runs.document[chosen]
        yield pd.DataFrame(
            {
                "run": runs.hashes(chosen),
                "doc_id": part["doc_id"].to_numpy()[document],
                "key": part["key"].to_numpy()[document],
                "place": runs.place[chosen].astype(np.int32),
            }
        )


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of the runs that a document was chosen to give, as it has them first."""
    for part in blocks(batches):
        runs = Runs(part["text"].tolist())
        chosen = _chosen(part, runs)
        document = runs.document[chosen]
        frame = pd.DataFrame(
            {
                "run": runs.hashes(chosen),
                "minimizer": runs.minimizer[chosen],
                "low": part["doc_id"].to_numpy()[document],
                "words": [runs.packed(at) for at in chosen.tolist()],
            }
        )
        high = {k: dict(zip(p.tolist(), h.tolist())) for k, (p, h) in enumerate(zip(part["places"], part["highs"]))}
        frame["high"] = [high[d][p] for d, p in zip(document.tolist(), runs.place[chosen].tolist())]
        yield frame


def shard_answers(rows: pd.DataFrame) -> pd.DataFrame:
    """run, firsts: for every window of a run the smallest document that has the window.

    `rows` has run, low, high, words and holds all runs of its minimizers. Runs that teach their
    documents nothing are left out.
    """
    low = rows.groupby("run", sort=False).agg(low=("low", "min"), high=("high", "max"), words=("words", "first"))
    raw = [np.frombuffer(w, dtype=np.uint8).reshape(-1, _BYTES) for w in low["words"]]
    length = np.array([len(r) for r in raw])
    wide = np.zeros((int(length.sum()), 8), dtype=np.uint8)
    wide[:, :_BYTES] = np.concatenate(raw)
    symbol = np.unique(wide.view("<u8").ravel(), return_inverse=True)[1] + 1
    begin = np.cumsum(length + 1) - length - 1  # one separator after every run
    run = np.repeat(np.arange(len(low)), length)
    text = np.zeros(int(length.sum()) + len(low), dtype=np.int64)
    text[np.arange(len(symbol)) + run] = symbol
    index = FmIndex(text, WORDS)
    windows = length - WORDS + 1
    owner = np.repeat(np.arange(len(low)), windows)
    start = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows) + begin[owner]
    left, right = np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64)
    for at in range(0, len(start), 200_000):
        part = start[at : at + 200_000]
        left[at : at + len(part)], right[at : at + len(part)] = index.intervals(text[part[:, None] + np.arange(WORDS)], True)
    run_at = np.append(np.repeat(np.arange(len(low)), length + 1), 0)  # the end is in no interval
    smallest = np.append(low["low"].to_numpy()[run_at[index.order]], np.iinfo(np.int64).max)
    edges, back = np.unique(left, return_inverse=True)
    ends = np.zeros(len(edges), dtype=np.int64)
    ends[back] = right
    firsts = np.minimum.reduceat(smallest, np.column_stack((edges, ends)).ravel())[::2][back]
    useful = np.zeros(len(low), dtype=bool)
    np.logical_or.at(useful, owner, firsts < low["high"].to_numpy()[owner])
    parts = np.split(firsts, np.cumsum(windows)[:-1])
    kept = np.flatnonzero(useful)
    return pd.DataFrame({"run": low.index.to_numpy()[kept], "firsts": [parts[k] for k in kept]})


def _answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All rows of a partition, in shards of bounded size that keep minimizers whole."""
    rows = [batch for batch in batches if len(batch)]
    if not rows:
        return
    rows = pd.concat(rows, ignore_index=True).sort_values("minimizer", kind="stable")
    size = rows["words"].str.len().to_numpy() // _BYTES + 1
    change = np.flatnonzero(np.diff(rows["minimizer"].to_numpy())) + 1
    shard = np.cumsum(size)[change - 1] // _SHARD if len(change) else np.zeros(0, dtype=np.int64)
    cuts = change[np.flatnonzero(np.diff(shard, prepend=0))]
    for part in np.split(np.arange(len(rows)), cuts):
        if len(part):
            yield shard_answers(rows.iloc[part])


def _strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts without the words that windows at `starts` cover."""
    for batch in blocks(batches):
        out = []
        for name, text, starts in zip(batch["name"], batch["text"], batch["starts"]):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            removed = 0
            if starts is not None and len(starts):
                change = np.zeros(len(words) + 1, dtype=np.int64)
                starts = np.unique(starts)
                np.add.at(change, starts, 1)
                np.add.at(change, starts + WORDS, -1)
                covered = np.cumsum(change[:-1]) > 0
                removed = int(covered.sum())
                words_kept = [w for w, gone in zip(words, covered.tolist()) if not gone]
            else:
                words_kept = words
            out.append((name, len(words), removed, b" ".join(words_kept).decode("utf-8", "surrogatepass")))
        yield pd.DataFrame(out, columns=["name", "n_words", "n_removed", "kept"])


def hot_minimizers(docs: DataFrame) -> DataFrame:
    """Minimizers that very many documents have, from about `_SAMPLE` documents chosen by key.

    What `_OFTEN` documents of the sample share is shared for certain and need not be counted;
    no other minimizer is likely to stand in more than a few thousandths of all documents. At
    most sampled runs / `_OFTEN` rows, whatever the size of the table.
    """
    share = min(1.0, _SAMPLE / max(1, docs.count()))
    few = docs.where(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    rows = few.mapInPandas(_places, "minimizer long, doc_id long, place int")
    counts = rows.groupBy("minimizer").agg(F.countDistinct("doc_id").alias("n"))
    return written(counts.where(F.col("n") >= _OFTEN).select("minimizer"), "hot")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept for every row of `docs` (doc_id, text).

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged; `kept` joins the words left by single spaces. A
    null text has no words. A document without id keeps all words and takes none from others;
    documents that share an id do not take words from each other and are told apart by 32 bits of
    their hashes. Words are compared by 40 bits of their hashes inside one minimizer of 64 bits.
    """
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").bitwiseAND(F.lit(0xFFFFFFFF)).alias("key")
    )
    usable = keyed.where("doc_id is not null and text is not null")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_minimizers(usable)
    rows = usable.mapInPandas(_places, "minimizer long, doc_id long, place int")
    part = F.when(F.col("hot"), F.pmod("doc_id", F.lit(_SPREAD))).otherwise(F.lit(-1)).alias("part")
    rows = rows.join(hot.withColumn("hot", F.lit(True)).hint("broadcast"), "minimizer", "left").select("*", part).drop("hot")
    # A window, as a join back to the rows would shuffle them again; it spills a large group.
    alike = Window.partitionBy("minimizer", "part")
    low, high = F.min("doc_id").over(alike).alias("low"), F.max("doc_id").over(alike).alias("high")
    places = rows.select("doc_id", "place", "part", low, high).where("part >= 0 or low < high").select("doc_id", "place")
    places = places.repartition(parts, "doc_id").groupBy(F.col("doc_id").alias("deal_"))
    places = places.agg(F.collect_set("place").alias("places"))

    # Rows with one doc_id share a list of places: it may name too many, which costs a look. All
    # three joins below use the same shuffle of the texts, so none may add a filter of its own.
    known = usable.repartition(parts, "doc_id")
    mine = known.join(places, F.col("doc_id") == F.col("deal_")).select("key", "doc_id", "text", "places")
    runs = mine.mapInPandas(_occurrences, "run long, doc_id long, key long, place int")
    givers = runs.groupBy("run").agg(F.min(F.struct("doc_id", "key", "place")).alias("m"), F.max("doc_id").alias("high"))
    givers = givers.select(F.col("m.doc_id").alias("deal_"), F.col("m.key").alias("key_"), "m.place", "high")
    givers = givers.repartition(parts, "deal_").groupBy("deal_", "key_").agg(F.collect_list(F.struct("place", "high")).alias("g"))
    givers = givers.select("deal_", "key_", F.col("g.place").alias("places"), F.col("g.high").alias("highs"))
    # The second equality is written so that it does not ask for another shuffle of the texts.
    same = (F.col("doc_id") == F.col("deal_")) & (F.col("key").bitwiseXOR(F.col("key_")) == 0)
    giving = known.join(givers, same).select("key", "doc_id", "text", "places", "highs")
    contents = giving.mapInPandas(_contents, "run long, minimizer long, low long, words binary, high long")
    answers = contents.repartition(parts, "minimizer").mapInPandas(_answers, "run long, firsts array<long>")
    found = runs.join(answers, "run")
    starts = F.filter(
        F.transform("firsts", lambda first, k: F.when(first < F.col("doc_id"), F.col("place") + k)), lambda x: x.isNotNull()
    )
    found = found.select("doc_id", "key", starts.alias("starts")).where(F.size("starts") > 0)
    found = found.repartition(parts, "doc_id").groupBy("doc_id", "key").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    found = found.withColumnsRenamed({"doc_id": "deal_", "key": "key_"})
    all_rows = known.join(found, same, "left").select("doc_id", "text", "starts")
    rest = keyed.where("doc_id is null or text is null")
    all_rows = all_rows.union(rest.select("doc_id", "text", F.lit(None).cast("array<int>").alias("starts")))
    all_rows = all_rows.select(F.col("doc_id").cast("string").alias("name"), "text", "starts")
    out = all_rows.mapInPandas(_strip, "name string, n_words long, n_removed long, kept string")
    return out.select(F.col("name").cast("long").alias("doc_id"), "n_words", "n_removed", "kept")
