"""Hard negatives by inner product: curve-ordered candidate blocks, read as their bounds ask.

All rows are sorted along a Hilbert curve through the dimensions of largest variance and written
as Parquet rows of one block each, with the least and greatest component of every dimension (the
zone map). Reading the zone maps alone, interval arithmetic bounds all scores of a block with an
anchor from above and below; only blocks that can hold rows of one of the anchor's windows of
scores are read. Thresholds come from the anchor's own neighbourhood on the curve, which is read
first. Scores are exact integers, and so is the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidelog.llm.common import written
from tidelog.llm.streams import map_records, names, runs

SCALE = 256  # components become floor(SCALE * x)
BLOCK_ROWS = 256
GROUP_BLOCKS = 32  # neighbouring blocks whose zone maps are one row
CHUNK_ANCHORS = 64  # neighbouring anchors that search together
_CURVE_DIMENSIONS, _CURVE_BITS = 12, 5  # 60 bits of a long
_LARGEST = 2**27  # of a component after scaling; 64-bit sums hold up to 512 such products
_EXACT = 2**53
_NO_ID = 2**63 - 1
_PAIR_SLOTS = 64
_TASK_BITS = 30
_BLOCK = "block long, group long, dims int, ids binary, labels binary, vectors binary, low binary, high binary, kinds array<long>"
_CHUNK = (
    "chunk long, own long, dims int, anchors array<long>, ids array<long>, labels array<long>, vectors binary, "
    "low array<long>, high array<long>"
)
_FOUND = "anchor long, window int, vec_id long, score long"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of `cells` (whole numbers under 2**bits a column):
    bits from the highest down, each undoes the turns and mirrors of the ones before."""
    x = cells.astype(np.int64).T.copy()
    for bit in range(bits - 1, 0, -1):
        side, below = np.int64(1 << bit), np.int64((1 << bit) - 1)
        for axis in range(len(x)):
            upper = (x[axis] & side) != 0
            swap = np.where(upper, 0, (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(upper, below, swap)
            x[axis] ^= swap
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    turn = np.zeros(x.shape[1], dtype=np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << bit), (1 << bit) - 1, 0)
    x ^= turn
    out = np.zeros(x.shape[1], dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in range(len(x)):
            out = (out << 1) | ((x[axis] >> bit) & 1)
    return out


def scaled(vector: Column) -> Column:
    """Whole components, or null where the vector takes no part: null, empty, a null or
    non-finite component, or one beyond 2**27 once scaled."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(SCALE) * x.cast("double")))
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(SCALE * x.cast("double")) <= _LARGEST))
    return F.when(F.coalesce(fits & (F.size(vector) > 0), F.lit(False)), whole)


def _matrix(column, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dims)


def _curve_axes(rows: DataFrame) -> dict[int, list[tuple[int, float, float]]]:
    """For each vector length the dimensions of largest variance with their least and greatest
    component. What is collected depends on the lengths only."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for dims in set(batch["dims"].to_pylist()):
                own = batch.filter(pa.compute.equal(batch["dims"], dims))
                x = _matrix(own["whole"], dims).astype(np.float64)
                now = [len(x), x.sum(0), (x * x).sum(0), x.min(0), x.max(0)]
                old = held.get(dims)
                if old is not None:
                    now = [a + b for a, b in zip(old[:3], now)] + [np.minimum(old[3], now[3]), np.maximum(old[4], now[4])]
                held[dims] = now
        for dims, (n, total, squares, low, high) in held.items():
            yield pa.RecordBatch.from_pydict(
                {"dims": [dims] * dims, "axis": list(range(dims)), "n": [n] * dims, "total": total, "squares": squares,
                 "low": low, "high": high},
                schema=pa.schema([("dims", pa.int32()), ("axis", pa.int32()), ("n", pa.int64()), *[(c, pa.float64()) for c in ("total", "squares", "low", "high")]]),
            )

    ddl = "dims int, axis int, n long, total double, squares double, low double, high double"
    found = rows.select("dims", "whole").mapInArrow(sums, ddl).groupBy("dims", "axis")
    found = found.agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")], F.min("low").alias("low"), F.max("high").alias("high"))
    spread = (F.col("squares") / F.col("n") - (F.col("total") / F.col("n")) ** 2).alias("spread")
    place = F.row_number().over(Window.partitionBy("dims").orderBy(F.desc("spread"), "axis"))
    best = found.select("dims", "axis", spread, "low", "high").withColumn("place", place)
    out: dict[int, list] = {}
    for r in best.where(F.col("place") <= _CURVE_DIMENSIONS).orderBy("dims", "place").collect():
        out.setdefault(r.dims, []).append((r.axis, r.low, r.high))
    return out


def candidate_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of rows (vec_id, label, whole, dims) along the curve, written to the shared folder."""
    axes = _curve_axes(rows)
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], _BLOCK).schema)

    @F.pandas_udf("long")
    def place(whole, dims):
        keys = np.zeros(len(whole), dtype=np.int64)
        for length in dims.unique():
            own = np.flatnonzero(dims == length)
            x = np.stack([np.asarray(v) for v in whole.iloc[own]])
            cells = np.stack(
                [(x[:, a] - low) * ((1 << _CURVE_BITS) - 1) // max(high - low, 1) for a, low, high in axes[int(length)]], axis=1
            )
            keys[own] = hilbert_keys(cells, _CURVE_BITS)
        return type(whole)(keys)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, group, length = TaskContext.get().partitionId() << _TASK_BITS, -1, -1
        for batch in batches:
            dims = np.asarray(batch["dims"])
            edges = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            out = []
            for begin, end in zip(edges, edges[1:]):
                for at in range(begin, end, BLOCK_ROWS):
                    part = batch.slice(at, min(BLOCK_ROWS, end - at))
                    d = int(dims[at])
                    x = _matrix(part["whole"], d).astype("<i4")
                    labels = np.asarray(part["label"])
                    if d != length or number - group >= GROUP_BLOCKS:
                        group, length = number, d
                    out.append((number, group, d, np.asarray(part["vec_id"]).astype("<i8").tobytes(), labels.astype("<i8").tobytes(),
                                x.tobytes(), x.min(0).tobytes(), x.max(0).tobytes(), sorted({*labels.tolist()})))
                    number += 1
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)

    placed = rows.withColumn("key", place("whole", "dims"))
    order = ["dims", "key", "vec_id", "label"]
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "label", "whole", "dims")
    return written(placed.mapInArrow(blocks, _BLOCK), "candidate-blocks")


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8"),
            np.frombuffer(row["vectors"], "<i4").reshape(-1, row["dims"]))


def _chunks(is_anchor):
    """Anchors of neighbouring blocks, with one window of any score."""

    def gather(records: Iterator[dict]) -> Iterator[dict]:
        for group, run in runs(records, "group"):
            held: list[tuple] = []
            for row in run:
                ids, labels, vectors = _opened(row)
                dims = row["dims"]
                # An anchor's name is its place; the first one's is the chunk's too.
                for k in np.flatnonzero(is_anchor(ids) & (ids != _NO_ID)):
                    held.append((row["block"] * BLOCK_ROWS + int(k), int(ids[k]), int(labels[k]), vectors[k].tobytes()))
            for at in range(0, len(held), CHUNK_ANCHORS):
                anchors, own_ids, own_labels, packed = zip(*held[at : at + CHUNK_ANCHORS])
                n = len(anchors)
                yield {"chunk": anchors[0], "own": group, "dims": dims, "anchors": anchors, "ids": own_ids, "labels": own_labels,
                       "vectors": b"".join(packed), "low": [-(2**62)] * n, "high": [2**62] * n}

    return gather


def _bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any vector between `low` and `high`."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def _numbers(x: np.ndarray, y: np.ndarray) -> type:
    """float64 where all sums of products stay exact in it (it multiplies faster), else int64."""
    if not len(x) or not len(y):
        return np.int64
    largest = float(np.abs(x).max()) * float(np.abs(y).max()) * x.shape[1]
    return np.float64 if largest < _EXACT else np.int64


def _choose(same: bool):
    """Which blocks of a group a chunk must read."""

    def choose(records: Iterator[dict]) -> Iterator[dict]:
        for row in records:
            d = row["dims"]
            anchors = np.frombuffer(row["vectors"], "<i4").reshape(-1, d)
            n = len(anchors)
            low, high = (np.frombuffer(b"".join(row[k]), "<i4").reshape(-1, d) for k in ("zone_low", "zone_high"))
            kind = _numbers(anchors, np.stack([low, high]).reshape(-1, d))
            least, greatest = _bounds(anchors.astype(kind), low.astype(kind), high.astype(kind))
            labels = row["labels"]
            if same:
                fits = np.array([[own in kinds for kinds in row["kinds"]] for own in labels])
            else:
                fits = np.array([[any(k != own for k in kinds) for kinds in row["kinds"]] for own in labels])
            from_, to = (np.array(row[k]).reshape(n, -1) for k in ("low", "high"))
            need = np.zeros(len(low), dtype=bool)
            for w in range(from_.shape[1]):
                need |= (fits & (greatest >= from_[:, w : w + 1]) & (least <= to[:, w : w + 1])).any(axis=0)
            if need.any():
                yield {**{k: row[k] for k in names(_CHUNK)}, "group": row["group"], "blocks": [b for b, on in zip(row["numbers"], need) if on]}

    return choose


def _best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, low: int, high: int, k: int) -> np.ndarray:
    found = np.flatnonzero(allowed & (scores >= low) & (scores <= high))
    if len(found) > k:
        own = scores[found]
        found = found[own >= np.partition(own, len(own) - k)[len(own) - k]]
    return found[np.lexsort((ids[found], -scores[found]))][:k]


def _read(k: int, same: bool):
    """Scores of the blocks of a group with the chunks that ask for them."""

    def read(records: Iterator[dict]) -> Iterator[dict]:
        for _, run in runs(records, "group"):
            held: dict[int, tuple] = {}
            for row in run:
                if row["chunk"] is None:
                    held[row["block"]] = _opened(row)
                    continue
                parts = [held[b] for b in row["blocks"]]
                ids, labels = (np.concatenate([p[n] for p in parts]) for n in (0, 1))
                candidates = np.concatenate([p[2] for p in parts])
                anchors = np.frombuffer(row["vectors"], "<i4").reshape(-1, row["dims"])
                kind = _numbers(anchors, candidates)
                scores = anchors.astype(kind) @ candidates.astype(kind).T
                n = len(anchors)
                low, high = (np.array(row[c]).reshape(n, -1) for c in ("low", "high"))
                for a in range(n):
                    allowed = ((labels == row["labels"][a]) == same) & (ids != row["ids"][a])
                    for w in range(low.shape[1]):
                        for c in _best(scores[a], ids, allowed, low[a, w], high[a, w], k):
                            yield {"anchor": row["anchors"][a], "window": w, "vec_id": int(ids[c]), "score": int(scores[a, c])}

    return read


def _answers(requests: DataFrame, blocks: DataFrame, k: int, same: bool) -> DataFrame:
    wanted = requests.select(F.explode("blocks").alias("block")).distinct()
    data = blocks.select("block", "group", "dims", "ids", "labels", "vectors").join(wanted, "block", "left_semi")
    asked = requests.select("group", "chunk", "dims", "blocks", F.col("anchors"), F.col("ids").alias("own_ids"),
                            F.col("labels").alias("own_labels"), "vectors", "low", "high")
    both = data.withColumnsRenamed({"ids": "packed_ids", "labels": "packed_labels"})
    both = both.unionByName(asked, allowMissingColumns=True)
    both = both.repartition("group").sortWithinPartitions("group", F.col("chunk").isNotNull())

    def unfolded(records: Iterator[dict]) -> Iterator[dict]:
        for row in records:
            if row["chunk"] is None:
                row["ids"], row["labels"] = row.pop("packed_ids"), row.pop("packed_labels")
            else:
                row["ids"], row["labels"] = row.pop("own_ids"), row.pop("own_labels")
            yield row

    read = _read(k, same)
    return map_records(both, lambda records: read(unfolded(records)), _FOUND)


def search(chunks: DataFrame, blocks: DataFrame, k: int, same: bool) -> DataFrame:
    """The first `k` rows of every window of every anchor: anchor, window, place, vec_id, score."""
    zones = blocks.groupBy("group", "dims").agg(
        F.sort_array(F.collect_list(F.struct("block", "low", "high", "kinds"))).alias("zone")
    )  # at most GROUP_BLOCKS rows each
    own = zones.select(F.col("group").alias("own"), F.col("zone.block").alias("blocks"))
    first = chunks.join(own, "own").withColumn("group", F.col("own"))
    near = written(_answers(first, blocks, k, same), "near-answers")

    # A window needs no score under the k-th best that the neighbourhood has.
    last = near.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    last = last.where(F.col("n") >= k).select("anchor", "window", "least")
    per = F.expr("size(low) div size(anchors)")
    flat = chunks.select("chunk", "anchors", per.alias("per"), F.posexplode("low").alias("at", "old"))
    flat = flat.select(
        "chunk", "at", "old", F.expr("anchors[at div per]").alias("anchor"), F.expr("cast(at % per as int)").alias("window")
    )
    raised = flat.join(last, ["anchor", "window"], "left").groupBy("chunk").agg(
        F.sort_array(F.collect_list(F.struct("at", F.greatest("old", "least").alias("low")))).alias("raised")
    )  # CHUNK_ANCHORS times the windows, at most
    sharp = chunks.join(raised, "chunk").withColumn("low", F.col("raised.low")).drop("raised")

    # Every chunk against the zone maps of every group but its own, dealt by slots.
    slots = F.explode(F.sequence(F.lit(0), F.lit(_PAIR_SLOTS - 1))).alias("slot")
    maps = zones.select(
        F.pmod(F.hash("group"), F.lit(_PAIR_SLOTS)).alias("slot"), "group", F.col("dims").alias("zone_dims"),
        F.col("zone.block").alias("numbers"), F.col("zone.low").alias("zone_low"), F.col("zone.high").alias("zone_high"),
        F.col("zone.kinds").alias("kinds"),
    )
    pairs = sharp.select("*", slots).join(maps, "slot")
    pairs = pairs.where((F.col("dims") == F.col("zone_dims")) & (F.col("own") != F.col("group")))
    requests = written(map_records(pairs, _choose(same), f"{_CHUNK}, group long, blocks array<long>"), "block-requests")
    found = near.unionByName(_answers(requests, blocks, k, same))
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(
    rows: DataFrame,
    is_anchor,
    positives: int = 5,
    negatives: int = 10,
    share: tuple[int, int] = (30, 90),
) -> DataFrame:
    """Rows of another label that score between `share` percent of a positive's score.

    `rows` has vec_id, label, embedding; `is_anchor` takes an array of ids and says which are
    anchors. An anchor's positives are its `positives` best rows of the same label and another
    vec_id; for each, the first `negatives` rows of another label in the window come back:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Higher scores come
    first, ties by smaller vec_id, null ids last. Rows with a null label or a vector that
    `scaled` gives no value for take no part; repeated rows count once; a vec_id with several
    vectors is one row for each; vectors of different length are not compared. Other columns are
    not read. An empty table, or none with anchors, gives no rows.
    """
    whole = scaled(F.col("embedding"))
    given = rows.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(_NO_ID)).alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("whole"))
    given = given.where(F.col("label").isNotNull() & F.col("whole").isNotNull()).distinct()
    blocks = candidate_blocks(given.withColumn("dims", F.size("whole")))
    chunks = written(map_records(blocks.select("block", "group", "dims", "ids", "labels", "vectors"), _chunks(is_anchor), _CHUNK), "anchors")

    good = written(search(chunks, blocks, positives, True), "positives")
    low, high = share
    # The window in whole numbers: -((-x) div 100) rounds up. Scores under zero have none.
    windows = good.select(
        "anchor", "place", F.when(F.col("score") >= 0, F.expr(f"-((-score * {low}L) div 100)")).otherwise(2**62).alias("low"),
        F.when(F.col("score") >= 0, F.expr(f"(score * {high}L) div 100")).otherwise(-(2**62)).alias("high"),
    )
    flat = chunks.select("chunk", F.posexplode("anchors").alias("at", "anchor"))
    flat = flat.select("chunk", "at", "anchor", F.explode(F.sequence(F.lit(1), F.lit(positives))).alias("place"))
    flat = flat.join(windows, ["anchor", "place"], "left")
    edges = F.struct("at", "place", F.coalesce("low", F.lit(2**62)).alias("low"), F.coalesce("high", F.lit(-(2**62))).alias("high"))
    edges = flat.groupBy("chunk").agg(F.sort_array(F.collect_list(edges)).alias("edges"))
    asking = chunks.drop("low", "high").join(edges, "chunk")
    asking = asking.withColumn("low", F.col("edges.low")).withColumn("high", F.col("edges.high")).drop("edges")
    bad = search(written(asking.select(*names(_CHUNK)), "windows"), blocks, negatives, False)

    own = chunks.select(F.explode(F.arrays_zip("anchors", "ids")).alias("a")).select("a.anchors", F.col("a.ids").alias("anchor_id"))
    good = good.select("anchor", F.col("place").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    bad = bad.select("anchor", (F.col("window") + 1).alias("positive"), F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = bad.join(good, ["anchor", "positive"]).join(own, F.col("anchor") == F.col("anchors"))

    def known(name: str) -> Column:
        return F.expr(f"nullif({name}, {_NO_ID}L)").alias(name)

    return out.select("anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")
