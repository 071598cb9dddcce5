"""Text quality from compressed sizes under a good and a bad dictionary."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import fit_logistic, is_held_out, sigmoid, spare, training_rows

SAMPLE_ROWS = 1500  # labelled texts of either class that a model is fitted on, at most
_PIECE = 2048  # bytes compressed by themselves, so that the dictionary counts along the whole text
_DICTIONARY = 64 << 10


@dataclass(frozen=True)
class QualityModel:
    good: bytes  # trained dictionaries
    bad: bytes
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]


def _pieces(text: str) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return [data[at : at + _PIECE] for at in range(0, len(data), _PIECE)]


@lru_cache(maxsize=4)
def _compressors(good: bytes, bad: bytes):
    import zstandard

    made = []
    for raw in (good, bad):
        known = zstandard.ZstdCompressionDict(raw)
        known.precompute_compress(level=3)
        made.append(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False))
    return made


def _own_lines(texts: Sequence[list[str]]) -> list[list[str]]:
    """The texts without lines that several of them share: a passage or a copy that happens to
    stand on one side says nothing about quality, yet a dictionary would learn it by heart."""
    seen = Counter(line for own in texts for t in own for line in set(t.split("\n")))
    return [["\n".join(x for x in t.split("\n") if seen[x] == 1) for t in own] for own in texts]


def _features(text: str, good, bad) -> tuple[float, float, float]:
    """Difference of the compressed sizes over the text's size and over the smaller of them,
    and the better compressed size over the text's."""
    size = with_good = with_bad = 0
    for piece in _pieces(text):
        size += len(piece)
        with_good += len(good.compress(piece))
        with_bad += len(bad.compress(piece))
    if not size:
        return 0.0, 0.0, 1.0
    best = min(with_good, with_bad)
    return (with_bad - with_good) / size, (with_bad - with_good) / best, min(1.0, best / size)


def fit_quality(rows: Sequence[tuple[int, int, str]]) -> QualityModel | None:
    """Model from (id, label, text); None unless both classes have at least eight texts.

    Each half of the texts is scored with dictionaries of the other half, and the calibration
    is fitted on those scores, so it sees texts the dictionaries do not know. The dictionaries
    kept are trained on all texts.
    """
    import zstandard

    sides = [[t for _, y, t in rows if y == value and t] for value in (0, 1)]
    if min(map(len, sides)) < 8:
        return None

    def dictionaries(texts: list[list[str]]) -> list[bytes]:
        made = []
        for own in _own_lines(texts):
            samples = [p for t in own for p in _pieces(t)]
            size = min(_DICTIONARY, max(1024, sum(map(len, samples)) // 8))
            try:
                made.append(zstandard.train_dictionary(size, samples).as_bytes())
            except zstandard.ZstdError:  # too little text to train on: the text itself serves
                made.append(b"".join(samples)[:size] or b"\x00" * 8)
        return made

    halves = [[own[k::2] for own in sides] for k in (0, 1)]
    x, y = [], []
    for fitted, scored in ((0, 1), (1, 0)):
        bad, good = dictionaries(halves[fitted])
        pair = _compressors(good, bad)
        for label, own in enumerate(halves[scored]):
            x += [_features(t, *pair) for t in own]
            y += [label] * len(own)
    x, y = np.array(x), np.array(y, dtype=float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights = fit_logistic((x - mean) / scale, y)
    bad, good = dictionaries(sides)
    return QualityModel(good, bad, tuple(weights), tuple(mean), tuple(scale))


def quality_scores(model: QualityModel, texts: Sequence[str]) -> np.ndarray:
    pair = _compressors(model.good, model.bad)
    x = np.array([_features(t, *pair) for t in texts]).reshape(-1, 3)
    x = (x - np.array(model.mean)) / np.array(model.scale)
    return sigmoid(np.hstack([x, np.ones((len(x), 1))]) @ np.array(model.weights))


def quality_column(docs: DataFrame, labels: DataFrame, text: Column) -> Column:
    """Likelihood of label 1 for `text`, by a model fitted on the labelled rows of `docs`."""
    model = fit_quality(training_rows(docs, labels, "quality", SAMPLE_ROWS))
    if model is None:
        return F.lit(0.5)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(quality_scores(shared.value, [t if isinstance(t, str) else "" for t in texts]))

    return score(text)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (likelihood of label 1), predicted, for every row.

    The whole text counts, whatever its length; a null text counts as empty. An empty text has
    the score of incompressible text without a difference. Without enough labels of both classes
    every score is 0.5. Null ids and repeated rows are kept and scored each.
    """
    scored = docs.select("doc_id", quality_column(docs, labels, F.col("text")).alias("score"))
    return scored.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs`, all columns, that the model does not reject. Columns of any name may
    come along; null texts are judged as empty ones."""
    score = quality_column(docs, labels, F.col("text"))
    name = spare(docs, "_score")
    return docs.withColumn(name, score).where(F.col(name) >= threshold).drop(name)
