"""Nearest neighbours by inner product with a hierarchical k-means tree."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000  # vectors the tree is fitted on, at most
CALIBRATION_QUERIES = 96  # vectors whose exact neighbours set the number of leaves to visit
TARGET_RECALL = 0.97
_BRANCHES = 8
_LEAF_ROWS = 64  # sample vectors in a leaf, about
_CELL = 4096  # vectors, and queries, handled together, about


def takes_part(vector: Column) -> Column:
    """Vectors that are not null or empty, have only finite components, and are not all zero."""
    inf = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass(frozen=True)
class Tree:
    """Nodes in breadth-first order. The inner product with x is largest where the distance to
    (x, sqrt(bound - |x|^2)) is smallest for a query (q, 0), so the tree lives in that space."""

    centres: np.ndarray  # one row per node
    children: tuple[tuple[int, ...], ...]
    leaf: tuple[int, ...]  # number of the leaf, -1 for inner nodes
    bound: float  # largest squared length of any vector

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.bound - (x * x).sum(axis=1), 0.0)
        return np.hstack([x, np.sqrt(rest)[:, None]])

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every vector: down the tree, each time to the nearest child."""
        x, out = self.lifted(x), np.zeros(len(x), dtype=np.int64)
        work = [(0, np.arange(len(x)))]
        while work:
            node, rows = work.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            own = np.array(self.children[node])
            nearest = _nearest(x[rows], self.centres[own])
            work += [(int(child), rows[nearest == k]) for k, child in enumerate(own)]
        return out

    def best_bins(self, queries: np.ndarray) -> Iterator[Iterator[int]]:
        """For every query its leaves, best first: a queue ordered by the distance to the node's
        centre gives the next node of the whole tree, leaf or inner."""
        q = np.hstack([queries, np.zeros((len(queries), 1))])
        lengths = (self.centres**2).sum(axis=1)
        for row in q:
            distance = lengths - 2 * (self.centres @ row)
            yield self._walk(distance.tolist())

    def _walk(self, distance: list[float]) -> Iterator[int]:
        queue = [(distance[0], 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
            for child in self.children[node]:
                heapq.heappush(queue, (distance[child], child))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None, :] - 2 * (x @ centres.T), axis=1)


def fit_tree(sample: np.ndarray, bound: float) -> Tree:
    """Splits every node of more than `_LEAF_ROWS` sample vectors by k-means, from the root on."""
    order = np.random.default_rng(3)
    empty = Tree(np.zeros((1, sample.shape[1] + 1)), ((),), (0,), bound)
    x = empty.lifted(sample)
    centres, children, leaf = [x.mean(axis=0)], [()], [-1]
    work, leaves = [(0, np.arange(len(x)))], 0
    while work:
        node, rows = work.pop(0)
        groups = _split(x[rows], order) if len(rows) > _LEAF_ROWS else []
        if len(groups) < 2:
            leaf[node] = leaves
            leaves += 1
            continue
        first = len(centres)
        for own in groups:
            centres.append(x[rows[own]].mean(axis=0))
            children.append(())
            leaf.append(-1)
        children[node] = tuple(range(first, len(centres)))
        work += [(first + k, rows[own]) for k, own in enumerate(groups)]
    return Tree(np.array(centres), tuple(children), tuple(leaf), bound)


def _split(x: np.ndarray, order: np.random.Generator) -> list[np.ndarray]:
    centres = x[order.choice(len(x), min(_BRANCHES, len(x)), replace=False)]
    for _ in range(12):
        nearest = _nearest(x, centres)
        centres = np.array([x[nearest == k].mean(axis=0) for k in range(len(centres)) if (nearest == k).any()])
    nearest = _nearest(x, centres)
    return [own for k in range(len(centres)) if len(own := np.flatnonzero(nearest == k))]


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def _top(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """For each query its k best rows but itself: score down, then vec_id up.

    The product over the whole block only preselects; scores that count are summed for each pair
    in the same order, so equal vectors have equal scores wherever they are.
    """
    q, x = _matrix(queries["embedding"]), _matrix(rows["embedding"])
    ids = rows["vec_id"].to_numpy()
    rough = q @ x.T
    out = []
    for own, vector, score in zip(queries["query_id"].to_numpy(), q, rough):
        score = np.where(ids == own, -np.inf, score)
        least = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else -np.inf
        slack = 1e-9 * (1.0 + abs(least)) if np.isfinite(least) else 0.0
        found = np.flatnonzero((score >= least - slack) & (ids != own))
        exact = (x[found] * vector).sum(axis=1)
        best = np.lexsort((ids[found], -exact))[:k]
        out.append(pd.DataFrame({"query_id": own, "vec_id": ids[found][best], "score": exact[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_neighbours(queries: list[tuple[int, list[float]]], rows: DataFrame, k: int) -> DataFrame:
    """Brute force for a bounded list of queries: each task reduces its rows to k per query."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(queries)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pd.DataFrame(shared.value, columns=["query_id", "embedding"])
        best = None
        for batch in batches:
            for at in range(0, len(batch), _CELL):
                found = _top(own, batch.iloc[at : at + _CELL], k)
                best = found if best is None else pd.concat([best, found])
            best = best.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
            best = best.groupby("query_id").head(k)
        if best is not None:
            yield best

    return _ranked(rows.mapInPandas(scan, "query_id long, vec_id long, score double"), k)


def calibrated_visits(tree: Tree, queries: list[tuple], exact: list[tuple[int, list[float]]], target: float) -> int:
    """Leaves to visit so that on average `target` of the exact neighbours are met."""
    wanted: dict[int, list[int]] = {}
    for (query, _), leaf in zip(exact, tree.assign(np.array([v for _, v in exact])).tolist()):
        wanted.setdefault(query, []).append(leaf)
    shares = np.zeros(tree.leaves)
    count = 0
    for (query, _), walk in zip(queries, tree.best_bins(np.array([v for _, v in queries]))):
        if query not in wanted:
            continue
        place = {leaf: k for k, leaf in enumerate(walk)}
        count += 1
        for leaf in wanted[query]:
            shares[place[leaf]] += 1 / len(wanted[query])
    if not count:
        return tree.leaves
    return int(np.searchsorted(np.cumsum(shares) / count, target - 1e-9) + 1)


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, k: int = 20, target: float = TARGET_RECALL
) -> DataFrame:
    """query_id, rank, vec_id, score: for every query row the k nearest found among all others.

    `vectors` has vec_id and embedding. Rows without vec_id, vectors that do not take part, and
    vectors of another length than most have are left out on both sides. Every row is indexed;
    the tree is fitted on at most `SAMPLE_ROWS` vectors chosen by a hash of the id, and the
    number of leaves is calibrated on exact neighbours of `CALIBRATION_QUERIES` of them. Of equal
    vectors only the k + 1 smallest ids can be an answer, so the others leave before the search.
    Leaves and the queries that visit them are cut into cells of bounded size. Ties go to the
    smaller vec_id. A repeated vec_id is a candidate once per distinct vector. Tables without two
    usable vectors give no rows. Repeated rows count once, here and in the samples.
    """
    base = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        is_query.alias("is_query"),
    )
    base = base.where(F.col("vec_id").isNotNull() & takes_part(F.col("embedding")))
    base = base.groupBy("vec_id", "embedding").agg(F.max("is_query").alias("is_query"))
    lengths = base.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").take(1)
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    base = base.where(F.size("embedding") == lengths[0]["n"])
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    rows = base.select("vec_id", "embedding").withColumn("_copy", F.row_number().over(copies))
    rows = rows.where(F.col("_copy") <= k + 1).select("vec_id", "embedding")

    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    bound = base.agg(F.max(square)).first()[0]
    order = [F.xxhash64("vec_id"), "vec_id"]
    sample = base.select("vec_id", "embedding").orderBy(*order).limit(SAMPLE_ROWS).collect()
    tree = fit_tree(np.array([r.embedding for r in sample]), float(bound))

    asked = base.where("is_query").select("vec_id", "embedding").orderBy(*order).limit(CALIBRATION_QUERIES)
    asked = [(r.vec_id, r.embedding) for r in asked.collect()]
    if not asked:
        return spark.createDataFrame([], schema)
    known = exact_neighbours(asked, rows, k).select("query_id", "vec_id").join(rows, "vec_id")
    known = [(r.query_id, r.embedding) for r in known.select("query_id", "embedding").collect()]
    visits = calibrated_visits(tree, asked, known, target) if known else tree.leaves

    shared = spark.sparkContext.broadcast(tree)

    @F.pandas_udf("long")
    def leaf_of(vector: pd.Series) -> pd.Series:
        return pd.Series(shared.value.assign(_matrix(vector)))

    indexed = rows.withColumn("leaf", leaf_of("embedding"))
    counts = {r.leaf: r["count"] for r in indexed.groupBy("leaf").count().collect()}

    @F.pandas_udf("array<long>")
    def leaves_of(vector: pd.Series) -> pd.Series:
        out = []
        for walk in shared.value.best_bins(_matrix(vector)):
            own, met = [], 0
            for leaf in walk:
                if len(own) >= visits and met > k:
                    break
                if leaf in counts:
                    own.append(leaf)
                    met += counts[leaf]
            out.append(own)
        return pd.Series(out)

    probes = base.where("is_query").select(F.col("vec_id").alias("query_id"), "embedding")
    probes = probes.withColumn("leaf", F.explode(leaves_of("embedding")))
    asking = {r.leaf: r["count"] for r in probes.groupBy("leaf").count().collect()}
    sizes = [(n, -(-counts[n] // _CELL), -(-asking.get(n, 0) // _CELL)) for n in counts if asking.get(n)]
    if not sizes:
        return spark.createDataFrame([], schema)
    cells = F.broadcast(spark.createDataFrame(sizes, "leaf long, parts long, blocks long"))  # one row per leaf
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    block = F.pmod(F.xxhash64("query_id"), F.col("blocks"))
    indexed = indexed.join(cells, "leaf").withColumn("part", part)
    indexed = indexed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    probes = probes.join(cells, "leaf").withColumn("block", block)
    probes = probes.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return _top(left.rename(columns={"question": "embedding"}), right.rename(columns={"vector": "embedding"}), k)

    keys = ["leaf", "part", "block"]
    asked_side = probes.select(*keys, "query_id", "embedding").toDF("a", "b", "c", "query_id", "question")
    row_side = indexed.select(*keys, "vec_id", "embedding").toDF("d", "e", "f", "vec_id", "vector")
    pairs = asked_side.groupBy("a", "b", "c").cogroup(row_side.groupBy("d", "e", "f"))
    found = pairs.applyInPandas(search, "query_id long, vec_id long, score double")
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
