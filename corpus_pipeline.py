"""Documents to training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but
the last return the columns of `documents`.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidelog.llm import decontaminate, ngram_join, packing, quality, secret_scan  # noqa: E402
from tidelog.llm.common import table, written  # noqa: E402
from tidelog.llm.tokens import vocabulary  # noqa: E402
from tidelog.session import prepare  # noqa: E402


def keep_good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the compression classifier rejects (score under 0.3)."""
    prepare(spark)
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group with five-word shingles alike by 0.8."""
    prepare(spark)
    return ngram_join.one_of_each(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold 0.8 of the shingles of a benchmark item."""
    prepare(spark)
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets, encoded ones too; every document stays, n_chars follows the new text."""
    prepare(spark)
    masked = docs.withColumn("text", secret_scan.redacted_column(F.col("text")))
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1,024 ids."""
    prepare(spark)
    pieces = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=0)
    return packing.piece_digest(pieces)


STAGES = [
    ("quality", keep_good_text),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]

# The classifier, the scan of decoded layers and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage returns is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
