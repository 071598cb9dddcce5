"""Benchmark items inside documents, by MinHash containment in size partitions.

Built-in column functions only. A shingle is five consecutive words; words are runs of letters
and digits in lower case, so punctuation and case do not hide a copy. A text with fewer than
five words is a single shingle of all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import spare, written

WORDS = 5
THRESHOLD = 0.8
_SMALL = 200_000  # rows up to which a counted side is broadcast


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _each_shingle(words: Column, value) -> Column:
    """`value(words of the shingle)` for every shingle, in order."""
    several = F.transform(
        F.sequence(F.lit(0), F.size(words) - WORDS),
        lambda at: value([F.get(words, at + k) for k in range(WORDS)]),
    )
    one = F.array(value([F.concat_ws(" ", words)]))
    return F.when(F.size(words) >= WORDS, several).when(F.size(words) > 0, one)


def _hashes(words: Column) -> Column:
    return F.array_distinct(_each_shingle(words, lambda own: F.xxhash64(*own)))


def _texts(words: Column) -> Column:
    return F.array_distinct(_each_shingle(words, lambda own: F.concat_ws(" ", *own)))


def _few(df: DataFrame) -> DataFrame:
    """Broadcast `df` if it has few rows, counted here; else Spark joins by shuffling."""
    return F.broadcast(df) if df.limit(_SMALL + 1).count() <= _SMALL else df


def item_sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """item_id, n_item, need, hash: the bottom-k MinHash sketch of every item with words.

    Items are partitioned by size, in powers of two. A document that holds the share `threshold`
    of n shingles misses at most n - ceil(threshold n) of them. With u the largest size of a
    partition, every sketch in it has the k = u - ceil(threshold u) + 1 smallest hashes (all, if
    there are fewer), so at least `need` >= 1 of a found item's sketch are in the document.
    """
    base = items.select("item_id", _words(F.col("text")).alias("words"))
    base = base.select("item_id", F.array_sort(_hashes(F.col("words"))).alias("hashes"))
    base = base.where(F.col("hashes").isNotNull()).distinct()
    n = F.size("hashes")
    upper = (F.pow(F.lit(2.0), F.floor(F.log2(n)) + 1) - 1).cast("int")
    base = base.withColumn("n_item", n).withColumn("upper", upper)
    k = F.col("upper") - F.ceil(F.col("upper") * threshold - 1e-9).cast("int") + 1
    base = base.withColumn("sketch", F.slice("hashes", 1, k))
    missing = F.col("n_item") - F.ceil(F.col("n_item") * threshold - 1e-9).cast("int")
    return base.select(
        "item_id", "n_item", (F.size("sketch") - missing).alias("need"), F.explode("sketch").alias("hash")
    )


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment, text_hash for every document that holds at
    least `threshold` of an item's distinct shingles.

    Documents are only probed with shingles whose hash is at most the largest in any sketch.
    Enough sketch hits make a candidate; containment is then counted on the shingles themselves.
    Null and empty texts, of either table, hold and are held by nothing; a null id is kept;
    repeated rows give one result row. A short text only holds an item that is the same words.
    """
    sketches = written(item_sketches(items, threshold), "sketches")
    sketches = _few(sketches)
    limit = sketches.agg(F.max("hash")).first()[0]
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _words(F.col("text")).alias("words"))
    probes = keyed.select("doc_id", "text_hash", _hashes(F.col("words")).alias("hashes"))
    low = F.filter("hashes", lambda h: h <= (limit if limit is not None else 0))
    probes = probes.select("doc_id", "text_hash", F.explode(low).alias("hash"))
    hits = probes.join(sketches, "hash").groupBy("doc_id", "text_hash", "item_id", "n_item", "need")
    hits = hits.agg(F.countDistinct("hash").alias("met")).where(F.col("met") >= F.col("need"))
    candidates = written(hits.select("doc_id", "text_hash", "item_id").distinct(), "candidates")

    wanted = candidates.groupBy("doc_id", "text_hash").agg(F.collect_set("item_id").alias("wanted"))
    wanted = wanted.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "wanted")
    found = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    found = found.join(_few(wanted), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))
    found = found.select("doc_id", "text_hash", "wanted", _words(F.col("text")).alias("words"))
    found = found.select("doc_id", "text_hash", "wanted", _texts(F.col("words")).alias("held"))
    found = found.select("doc_id", "text_hash", "held", F.explode("wanted").alias("item_id"))
    texts = items.select(F.col("item_id").alias("i"), _words(F.col("text")).alias("words"))
    texts = texts.select("i", _texts(F.col("words")).alias("shingles")).where("shingles is not null")
    pairs = found.join(_few(texts), F.col("item_id") == F.col("i"))
    shared = F.size(F.array_intersect("shingles", "held")).cast("long")
    n_item = F.size("shingles").cast("long")
    pairs = pairs.select("doc_id", "item_id", "text_hash", n_item.alias("n_item"), shared.alias("n_shared"))
    pairs = pairs.where(F.col("n_shared") >= F.ceil(F.col("n_item") * threshold - 1e-9)).distinct()
    return pairs.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def clean_documents(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, that hold no item. Columns of any name may come along."""
    d, h = spare(docs, "_d"), spare(docs, "_h")
    bad = contained_items(docs, items, threshold)
    bad = bad.select(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).distinct()
    bad = _few(written(bad, "contaminated"))
    same = F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(h))
    return docs.join(bad, same, "left_anti")
