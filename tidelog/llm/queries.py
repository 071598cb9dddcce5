"""One registered query per operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import (
    conversations,
    decontaminate,
    fingerprints,
    hard_negatives,
    neighbours,
    ngram_join,
    packing,
    quality,
    secret_scan,
    substring_dedup,
    token_files,
    toxicity,
    url_filter,
)
from tidelog.llm.common import table
from tidelog.llm.tokens import vocabulary
from tidelog.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Fixed rules of the URL query: host, beginning of the path, verdict.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def _query(sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@_query()
def op1_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest_neighbours(rows, F.col("vec_id") % 20 == 0)


@_query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@_query(
    f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
    g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM s),
    f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
    c AS (SELECT DISTINCT g.doc_id, g.i + k.k AS p FROM g JOIN f USING (g)
          CROSS JOIN range(13) AS k(k) WHERE f.first < g.doc_id),
    r AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
           CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
           sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1),
               lambda p: NOT coalesce(list_contains(ps, p), false)), lambda p: w[p]), ' '), '')) AS kept_sha256
    FROM d LEFT JOIN r ON d.doc_id = r.doc_id
    """
)
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    return found.select("doc_id", "n_words", "n_removed", digest)


def _shingled(name: str, key: str) -> str:
    return rf"""
    SELECT DISTINCT {key}, unnest(CASE
        WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
    FROM (SELECT {key}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM {name})
    """


@_query(
    f"""
    WITH d AS ({_shingled("documents", "doc_id")}), b AS ({_shingled("benchmark", "item_id")}),
    n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
    SELECT doc_id, item_id, n_item, count(*) AS n_shared,
           CAST(count(*) AS DOUBLE) / n_item AS containment
    FROM d JOIN b USING (g) JOIN n USING (item_id)
    GROUP BY doc_id, item_id, n_item HAVING 10 * count(*) >= 8 * n_item
    """
)
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.contained_items(docs, items)
    return found.select("doc_id", "item_id", "n_item", "n_shared", "containment").distinct()


@_query()
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    digest = secret_scan.base_digest(F.col("base")).alias("base_sha256")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", digest, "spans")


@_query()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.json")
    return packing.piece_digest(packing.pack_documents(table(spark, sf_dir, "documents"), path, end_id=0))


@_query()
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query(
    r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE
            WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g)
          WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
    e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
          WHERE 100 * p.i >= 80 * (x.n + y.n - p.i)),
    r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents
          UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
    SELECT r.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id
    FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
    """
)
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@_query()
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, RULES, url_filter.labelled_table())


@_query()
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("word_bpe_49k.json")
    return token_files.token_files(table(spark, sf_dir, "documents"), path, end_id=1)


@_query()
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = conversations.repair_conversations(conversations.damaged(rows))
    every = rows.select(F.col("conv_id").alias("_conv_id")).distinct()
    nothing = {name: F.lit(0).cast("long") for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    nothing |= {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    joined = every.join(found, F.col("_conv_id").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(F.col("_conv_id").alias("conv_id"), *[F.coalesce(name, value).alias(name) for name, value in nothing.items()])


@_query(
    """
    WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(
            list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM e a JOIN e c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank,
           s.vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id)
    QUALIFY row_number() OVER w <= 10
    """
)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.hard_negatives(rows, lambda ids: ids % 100 == 0)


@_query()
def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    return found.select("doc_id", "n_chars", digest, "fingerprint", "edited_fingerprint", "near_edited", "near_next")
