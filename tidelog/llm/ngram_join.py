"""Documents whose sets of word shingles are alike, by adaptive multi-match prefixes.

A set of n shingles linked with another shares at least ceil(0.8 n) of its own, so it misses at
most m = n - ceil(0.8 n). In any common order of all shingles, the first l shared ones are among
the first m + l of either set: prefixes of that length must share l shingles. A longer prefix
asks for more matches; each document takes the length that promises the least work.

1. `screen` uses the order of hashes and l in proportion to n: documents with too few prefix
   shingles that any other text has are linked with nothing and leave.
2. The rest are put in the order of exact document frequency, rare ones first, and each chooses
   its l from the frequencies in its prefix.
3. Within the documents of a shingle, links are looked for in three steps: every document with
   its best pivot, documents with random pivots of other components, then whatever pairs of
   different components are left. Pairs known to be connected are not compared again, so a large group of
   copies costs a number of comparisons in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import blocks, mix, sequence_hash, spare, word_hashes, written

WORDS = 5
_SMALL = 200_000  # rows up to which a counted side is broadcast
_SCREEN = 16  # in the first step l is n // 16, and at least 1
_LONGEST = 4  # largest l of the second step
_PIVOTS = 4  # random pivots of a shingle in each turn
_TURNS = 2  # turns of the second step, at most
_ENTRIES = 1 << 17  # entries of prefixes that a task lists at once, and one prefix
_VERIFY = 8.0  # cost of comparing two sets, in list entries read


def shingle_sets(texts: list) -> Iterator[np.ndarray]:
    """Sorted hashes of the distinct five-word shingles of each text; of fewer words, one hash."""
    words, offsets = word_hashes(texts, lower=True)
    shingles = sequence_hash(words, WORDS)
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if end - begin >= WORDS:
            yield np.unique(shingles[begin : end - WORDS + 1])
        elif end > begin:
            yield mix(sequence_hash(words[begin:end], end - begin) ^ np.uint64(end - begin))
        else:
            yield words[:0]


def _signature(own: np.ndarray) -> int:
    """64 bits for the whole set; 0 only for the empty one."""
    if not len(own):
        return 0
    value = mix(np.add.reduce(mix(own ^ np.uint64(len(own)))).reshape(1))[0]
    return int(value.astype(np.int64)) or 1


def missing(n):
    """How many of n shingles a linked set may lack: n - ceil(0.8 n)."""
    return n - (4 * n + 4) // 5


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node (signature of the set), n_shingles, for every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in blocks(batches):
            nodes, counts = [], []
            for own in shingle_sets(batch["text"].tolist()):
                nodes.append(_signature(own))
                counts.append(len(own))
            yield pd.DataFrame({"key": batch["key"], "text_hash": batch["text_hash"], "node": nodes, "n_shingles": counts})

    keyed = docs.select(F.col("doc_id").cast("string").alias("key"), F.xxhash64("text").alias("text_hash"), "text")
    rows = keyed.mapInPandas(run, "key string, text_hash long, node long, n_shingles long")
    return rows.select(F.col("key").cast("long").alias("doc_id"), "text_hash", "node", "n_shingles")


def screen(docs: DataFrame) -> DataFrame:
    """Nodes that may have a link: enough shingles of their prefix are in other sets too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in blocks(batches):
            tokens, nodes, needs = [], [], []
            for own in shingle_sets(batch["text"].tolist()):
                n = len(own)
                if not n or (node := _signature(own)) in seen:
                    continue
                seen.add(node)
                prefix = own[: missing(n) + max(1, n // _SCREEN)]
                least = (4 * n + 4) // 5  # the smallest set it may be linked with
                tokens.append(prefix)
                nodes.append(np.full(len(prefix), node, dtype=np.int64))
                needs.append(np.full(len(prefix), max(1, least // _SCREEN), dtype=np.int32))
            if tokens:
                flat = np.concatenate(tokens).view(np.int64)
                yield pd.DataFrame({"token": flat, "node": np.concatenate(nodes), "need": np.concatenate(needs)})

    rows = docs.select("text").mapInPandas(run, "token long, node long, need int")
    shared = rows.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    shared = shared.where("low < high").select("token")
    met = rows.join(shared, "token", "left_semi").groupBy("node").agg(F.count("*").alias("met"), F.max("need").alias("need"))
    return met.where("met >= need").select("node")


def _few(df: DataFrame) -> DataFrame:
    """Broadcast `df` if it has few rows, counted here; else Spark joins by shuffling."""
    return F.broadcast(df) if df.limit(_SMALL + 1).count() <= _SMALL else df


def full_sets(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """node, n, tokens (packed) of the sets in `marked`, which has one row (d, h) per node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in blocks(batches):
            found = list(shingle_sets(batch["text"].tolist()))
            yield pd.DataFrame(
                {"node": [_signature(s) for s in found], "n": [len(s) for s in found], "tokens": [s.tobytes() for s in found]}
            )

    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("h"))
    texts = docs.select("doc_id", "text").join(_few(marked), same).select("text")
    sets = texts.mapInPandas(run, "node long, n int, tokens binary")
    return sets.dropDuplicates(["node"])


def _tokens(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.int64)


def _listed(prefixes: list[tuple]) -> pd.DataFrame:
    """token, node, n, place, want: a row for each token of each (tokens, node, n, first place, want)."""
    size = [len(own) for own, *_ in prefixes]
    found = {"token": np.concatenate([np.asarray(own, dtype=np.int64) for own, *_ in prefixes])}
    for k, (name, kind) in enumerate((("node", np.int64), ("n", np.int32), ("place", np.int32), ("want", np.int32)), 1):
        found[name] = np.repeat(np.array([p[k] for p in prefixes], dtype=kind), size)
    found["place"] += np.concatenate([np.arange(n, dtype=np.int32) for n in size])
    return pd.DataFrame(found)


def prefix_entries(sets: DataFrame) -> DataFrame:
    """token, node, n, place, want: the frequent part of every prefix.

    The order is by number of sets, then by hash. Shingles of a single set come first and match
    nothing, so only the others are counted, joined back and listed; `place` is the position in
    the whole order. `want` is the document's l.
    """

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in blocks(batches, 500):
            own = [_tokens(raw) for raw in batch["tokens"]]
            size = [len(x) for x in own]
            yield pd.DataFrame({"token": np.concatenate(own), "node": np.repeat(batch["node"].to_numpy(), size), "n": np.repeat(batch["n"].to_numpy(), size)})

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in blocks(batches):
            out: list[tuple] = []
            held = 0
            for node, n, single, counts, tokens in batch[["node", "n", "single", "counts", "tokens"]].itertuples(index=False):
                lack, best = missing(n), None
                for length in range(1, min(_LONGEST, n - lack) + 1):
                    read = counts[: max(0, lack + length - single)].sum()
                    cost = read * (1.0 + _VERIFY / length)
                    if best is None or cost < best[0]:
                        best = (cost, length)
                length = best[1]
                own = tokens[: max(0, lack + length - single)]
                out.append((own, node, n, single, length))
                held += len(own)
                if held > _ENTRIES:
                    yield _listed(out)
                    out, held = [], 0
            if held:
                yield _listed(out)

    rows = sets.mapInPandas(explode, "token long, node long, n int")
    counts = rows.groupBy("token").count().where("count > 1")
    lists = rows.join(counts, "token").groupBy("node", "n").agg(F.collect_list(F.struct("count", "token")).alias("own"))
    single = F.col("n") - F.size("own")
    lack = F.col("n") - F.ceil(F.col("n") * F.lit(4) / F.lit(5) - F.lit(1e-9)).cast("int")
    own = F.slice(F.sort_array("own"), 1, F.greatest(F.lit(0), lack + _LONGEST - single))
    lists = lists.select("node", "n", single.alias("single"), own.alias("own"))
    lists = lists.select("node", "n", "single", F.col("own.count").alias("counts"), F.col("own.token").alias("tokens"))
    lists = lists.where(F.size("counts") > 0)
    return lists.mapInPandas(choose, "token long, node long, n int, place int, want int")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike: 100 * intersection >= 80 * union."""

    @F.pandas_udf("boolean")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right):
            x, y = _tokens(x), _tokens(y)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= 80 * (len(x) + len(y) - both))
        return pd.Series(out)

    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(alike("x", "y")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node of it) of every node in `edges` (a, b).

    Large-star and small-star steps in turn, each an aggregation and a join, written after every
    round so that a lost executor costs one round at most; ends when nothing changes.
    """
    ways = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")

    def toward_least(pairs: DataFrame, large: bool) -> DataFrame:
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        found = pairs.join(least, "u")
        if large:
            found = found.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            found = found.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return found.where("u <> v").distinct()

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = state(ways)
    while True:
        both = ways.union(ways.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ways = written(toward_least(toward_least(both, True), False), "links")
        before, now = now, state(ways)
        if before == now:
            break
    ends = ways.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(ways.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _with_components(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    if known is None:
        return rows.withColumn("component", F.col("node"))
    own = known.select(F.col("node"), F.col("component").alias("_c"))
    return rows.join(own, "node", "left").withColumn("component", F.coalesce("_c", "node")).drop("_c")


def _possible(before: Column) -> Column:
    """Whether two sets can be linked if they share a shingle at places `place` and `place2` and
    `before` shared ones stand before it: sizes must fit, and what follows must suffice."""
    least = F.ceil((F.col("n") + F.col("n2")) * F.lit(4) / F.lit(9) - F.lit(1e-9))
    rest = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))
    return (5 * F.least("n", "n2") >= 4 * F.greatest("n", "n2")) & (before + rest >= least)


def _stars(entries: DataFrame, order: Column) -> DataFrame:
    """node, node2: each document of a shingle with the shingle's pivot, the least by `order`."""
    own = F.struct(order.alias("order"), "node", "n", "place", "want")
    pivots = entries.groupBy("token").agg(F.min(own).alias("p"), F.count("*").alias("many")).where("many > 1")
    pivots = pivots.select("token", *[F.col(f"p.{c}").alias(f"{c}2") for c in ("node", "n", "place", "want")])
    before = F.least(F.least("place", "place2"), F.least("want", "want2") - 1)
    found = entries.join(pivots, "token").where("node <> node2").where(_possible(before))
    return found.select("node", "node2")


def alike_sets(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """node, component of all nodes in `marked` that have a link."""
    sets = written(full_sets(docs, marked), "sets")
    entries = written(prefix_entries(sets), "prefixes")
    stars = _stars(entries, F.struct("node")).groupBy("node", "node2").agg(F.count("*").alias("met"))
    best = stars.groupBy("node").agg(F.max(F.struct("met", F.col("node2").alias("pivot"))).alias("m"))
    first = best.select(F.col("node").alias("a"), F.col("m.pivot").alias("b"))
    edges = written(linked(first, sets), "edges")
    known = written(components(edges), "components")

    for turn in range(_TURNS):
        pairs = None
        for seed in range(turn * _PIVOTS, (turn + 1) * _PIVOTS):
            found = _with_components(_stars(entries, F.struct(F.xxhash64(F.lit(seed), "token", "node"))), known)
            other = known.select(F.col("node").alias("node2"), F.col("component").alias("c2"))
            found = found.join(other, "node2", "left").where(F.col("component") != F.coalesce("c2", "node2"))
            found = found.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))
            pairs = found if pairs is None else pairs.union(found)
        more = written(linked(written(pairs.distinct(), "pairs"), sets), "edges")
        if more.isEmpty():
            break
        edges = edges.union(more)
        known = written(components(edges), "components")

    third = written(remaining_pairs(entries, known), "pairs")
    if third.isEmpty():
        return known
    edges = edges.union(written(linked(third, sets), "edges"))
    return written(components(edges), "components")


def remaining_pairs(entries: DataFrame, known: DataFrame) -> DataFrame:
    """Every pair (a, b) in different components that shares enough prefix shingles.

    For each shingle, the documents outside its largest component meet all its documents. A pair
    comes out once, at the first shingle its prefixes share.
    """
    rows = _with_components(entries, known)
    sides = rows.groupBy("token", "component").agg(F.count("*").alias("many"))
    main = sides.groupBy("token").agg(
        F.max(F.struct("many", "component")).alias("m"), F.count("*").alias("sides")
    )
    main = main.where("sides > 1").select("token", F.col("m.component").alias("main"))
    listed = F.sort_array(F.collect_list(F.struct("place", "token")))
    prefixes = entries.groupBy("node").agg(listed.alias("p")).select("node", F.col("p.token").alias("prefix"))
    rows = written(rows.join(main, "token").join(prefixes, "node"), "entries")
    few = rows.where("component <> main")
    all_rows = rows.drop("main").toDF(*[f"{c}2" for c in rows.drop("main").columns])
    once = (F.col("component2") == F.col("main")) | (F.col("node") < F.col("node2"))
    same = (F.col("token") == F.col("token2")) & (F.col("component") != F.col("component2")) & once
    both = F.array_intersect("prefix", "prefix2")
    first = F.element_at(both, 1) == F.col("token")
    enough = F.size(both) >= F.least("want", "want2")
    met = few.join(all_rows, same & _possible(F.lit(0)) & first & enough)
    return met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash, group for every row of `docs` (doc_id, text).

    component_id is the smallest doc_id that links reach, the document's own included. Texts with
    equal sets are one node from the start. Null and empty texts have no shingles and stand
    alone. A null doc_id takes part, but is no component_id unless nothing else is there; rows
    with the same doc_id are judged by their own texts. `group` names the component, null for texts
    without words. Shingles are compared as 64-bit hashes.
    """
    nodes = written(signatures(docs), "signatures")
    alive = screen(docs)
    own = nodes.where("n_shingles > 0").join(alive, "node", "left_semi")
    marked = own.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("m"))
    marked = written(marked.select(F.col("m.doc_id").alias("d"), F.col("m.text_hash").alias("h")), "marked")
    known = alike_sets(docs, marked)
    smallest = nodes.where("n_shingles > 0").groupBy("node", "n_shingles").agg(F.min("doc_id").alias("least"))
    smallest = _with_components(smallest, known)
    groups = smallest.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = smallest.join(groups, "component").select("node", "component_id", F.col("component").alias("group"))
    alone = nodes.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    alone = alone.withColumn("group", F.lit(None).cast("long"))
    rest = nodes.where("n_shingles > 0").join(by_node, "node")
    columns = ["doc_id", "n_shingles", "component_id", "text_hash", "group"]
    return rest.select(columns).union(alone.select(columns))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, with one document of each group of near-duplicates.

    Kept is the smallest doc_id (one with an id before one without); texts without words are no
    duplicates of anything and all stay. Columns of any name may come along.
    """
    d, h = spare(docs, "_d"), spare(docs, "_h")
    found = written(near_duplicates(docs), "near-duplicates").where("group is not null")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash")).alias("m")
    kept = found.groupBy("group").agg(best).select(F.col("m.doc_id").alias(d), F.col("m.text_hash").alias(h))
    kept = written(kept, "kept")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    same = F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(h))
    rows = docs.where(worded).join(_few(kept), same, "left_semi")
    copies = found.groupBy("doc_id", "text_hash").count().where("count > 1")
    again = copies.join(kept, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col("text_hash") == F.col(h)), "left_semi")
    if not again.isEmpty():  # whole rows that repeat
        rows = rows.dropDuplicates(["doc_id", "text"])
    return rows.union(docs.where(~worded))
