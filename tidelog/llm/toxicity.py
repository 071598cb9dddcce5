"""Toxicity by a support vector machine on gap-weighted subsequences of words.

The kernel of two words sums, over all subsequences of three letters, lambda to the span in
either word, divided by both norms. Letters may lie apart, so letters put between those of an
insult, other endings and other spellings keep most of the value. A few landmark words span
the Nystrom features; the machine is linear in them, and so linear in the subsequences of the
landmarks. All weights are therefore folded into one table indexed by letter triples.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import blocks, fit_logistic, is_held_out, sigmoid, training_rows

SAMPLE_ROWS = 1500  # labelled texts of either class that a model is fitted on, at most
LANDMARKS = 96
DECAY = 0.7
_NULL_ID = -(2**63) + 1  # inside tasks, for rows without doc_id
_WINDOW = 16  # letters; longer words are looked at in overlapping windows
_SIDE = 64  # codes of letters
_INSTANCES = 20_000  # words of harmless texts the machine is fitted on, at most
_CACHED = 400_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPELT = re.compile(r"(?<!\S)(?:\w[\x20\t]){2,}\w(?!\S)")
_EDGES = ".,;:!?\"'()[]{}<>%$&*#|+=/\\~^`"


@lru_cache(maxsize=64)
def _triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all triples inside a word, and lambda to the span of each."""
    at = np.array(list(combinations(range(length), 3)), dtype=np.int64).reshape(-1, 3)
    return at, DECAY ** (at[:, 2] - at[:, 0] + 1.0)


def _letters(word: str) -> list[int]:
    return [c - 96 if 97 <= c <= 122 else 27 + c % 37 for c in map(ord, word)]


def _windows(word: str) -> list[str]:
    if len(word) <= _WINDOW:
        return [word]
    half = _WINDOW // 2
    return [word[at : at + _WINDOW] for at in range(0, len(word) - half, half)]


def words_of(text: str) -> set[str]:
    """The words of a text in lower case without marks at their ends. Words with marks inside
    count without them too, and letters written one by one count as a word."""
    low = text.lower()
    found = {w.strip(_EDGES) for w in _WORD.findall(low)}
    found |= {"".join(filter(str.isalnum, w)) for w in found if not w.isalnum()}
    for spelt in _SPELT.findall(low):
        found.add("".join(spelt.split()))
    found.discard("")
    return found


def _by_length(words: Sequence[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Window length -> (numbers of the words, letter codes of their windows)."""
    groups = defaultdict(lambda: ([], []))
    for k, word in enumerate(words):
        for part in _windows(word):
            if len(part) >= 3:
                groups[len(part)][0].append(k)
                groups[len(part)][1].append(_letters(part))
    out = {}
    for length, (numbers, letters) in groups.items():
        out[length] = (np.array(numbers), np.array(letters, dtype=np.int32))
    return out


def _codes(letters: np.ndarray) -> np.ndarray:
    """Codes of all letter triples of each window."""
    at, _ = _triples(letters.shape[1])
    first, second, third = letters[:, at[:, 0]], letters[:, at[:, 1]], letters[:, at[:, 2]]
    return (first * _SIDE + second) * _SIDE + third


def _norms(codes: np.ndarray) -> np.ndarray:
    """Root of the kernel of each window (a row of letter codes) with itself.

    The usual recursion over prefixes, for all windows of one length at a time; as both sides
    are the same window only the order of prefixes matters, not which side is which.
    """
    count, length = codes.shape
    same = [[(codes[:, j] == codes[:, k]).astype(np.float64) for k in range(length)] for j in range(length)]
    inner = [[np.ones(count)] * (length + 1) for _ in range(length + 1)]
    for _ in range(2):
        outer = [[np.zeros(count)] * (length + 1) for _ in range(length + 1)]
        for j in range(1, length + 1):
            run = np.zeros(count)
            for k in range(1, length + 1):
                run = DECAY * run + same[j - 1][k - 1] * (DECAY**2 * inner[j - 1][k - 1])
                outer[j][k] = DECAY * outer[j - 1][k] + run
        inner = outer
    total = np.zeros(count)
    for j in range(length):
        for k in range(length):
            total += same[j][k] * inner[j][k]
    return DECAY * np.sqrt(total)


def subsequence_kernel(words: Sequence[str], landmarks: Sequence[str]) -> np.ndarray:
    """Normalised kernel of every word with every landmark; of a long word its best window."""
    columns: dict[int, int] = {}
    entries = []
    for m, mark in enumerate(landmarks):
        for code, value in zip(*_profile(mark)):
            entries.append((columns.setdefault(code, len(columns)), m, value))
    side = np.zeros((len(columns) + 1, len(landmarks)))
    for row, m, value in entries:
        side[row, m] += value
    index = np.full(_SIDE**3, len(columns), dtype=np.int64)
    index[list(columns)] = list(columns.values())
    out = np.zeros((len(words), len(landmarks)))
    width = len(columns) + 1
    for length, (numbers, letters) in _by_length(words).items():
        _, weight = _triples(length)
        for at in range(0, len(numbers), 512):
            codes = _codes(letters[at : at + 512])
            cells = index[codes] + np.arange(len(codes))[:, None] * width
            spread = np.broadcast_to(weight, codes.shape).ravel()
            counts = np.bincount(cells.ravel(), spread, len(codes) * width)
            values = counts.reshape(-1, width) @ side / _norms(letters[at : at + 512])[:, None]
            np.maximum.at(out, numbers[at : at + 512], values)
    return out


def _profile(mark: str) -> tuple[list[int], list[float]]:
    """Triples of a landmark and their weights over its norm."""
    letters = np.array([_letters(mark[:_WINDOW])], dtype=np.int32)
    _, weight = _triples(letters.shape[1])
    return _codes(letters)[0].tolist(), (weight / _norms(letters)[0]).tolist()


@dataclass(frozen=True)
class ToxicityModel:
    table: np.ndarray  # weight of each letter triple
    bias: float
    calibration: tuple[float, float]


def _fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps; both classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-9
    for _ in range(40):
        margin = 1 - y * (x @ w)
        active = margin > 0
        xa, wa = x[active], weight[active]
        gradient = ridge * w - 2 * xa.T @ (wa * y[active] * margin[active])
        step = np.linalg.solve(2 * (xa * wa[:, None]).T @ xa + np.diag(ridge), gradient)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def word_margins(model: ToxicityModel, words: Sequence[str]) -> np.ndarray:
    out = np.full(len(words), model.bias)
    best = np.full(len(words), -np.inf)
    for length, (numbers, letters) in _by_length(words).items():
        weight = _triples(length)[1].astype(np.float32)
        for at in range(0, len(numbers), 4096):
            part = letters[at : at + 4096]
            value = model.table[_codes(part)] @ weight
            np.maximum.at(best, numbers[at : at + 4096], value / _norms(part) + model.bias)
    return np.where(np.isfinite(best), best, out)


def _folded(landmarks: list[str], alpha: np.ndarray) -> np.ndarray:
    table = np.zeros(_SIDE**3)
    for mark, factor in zip(landmarks, alpha):
        codes, values = _profile(mark)
        np.add.at(table, codes, factor * np.array(values))
    return table.astype(np.float32)


def fit_toxicity(rows: Sequence[tuple[int, int, str]]) -> ToxicityModel | None:
    """Model from (id, label, text); None unless both classes have at least eight texts.

    A text is toxic if one of its words is: words frequent in toxic texts and absent from the
    others start as positive examples, then each toxic text gives the word that the machine
    ranks highest in it. All words of harmless texts are negative.
    """
    texts = sorted({(y, t) for _, y, t in rows})
    bags = [(y, words_of(t)) for y, t in texts]
    toxic = [{w for w in b if len(w) >= 3} for y, b in bags if y == 1]
    clean = [{w for w in b if len(w) >= 3} for y, b in bags if y == 0]
    if min(len(toxic), len(clean)) < 8:
        return None
    harmless = Counter(w for bag in clean for w in bag)
    # Copies repeat their words beside the same neighbours; an insult stands anywhere.
    beside = defaultdict(set)
    for y, text in texts:
        if y == 1:
            own = [w.strip(_EDGES) for w in _WORD.findall(text.lower())]
            for before, word in zip(["", *own], own):
                if len(word) >= 3 and word not in harmless:
                    beside[word].add(before)
    seen = {w: len(b) for w, b in beside.items()}
    least = max(3, len(toxic) // 100)
    ranked = sorted(seen, key=lambda w: (-seen[w], w))
    positive = [w for w in ranked if seen[w] >= least][:400] or ranked[:20]
    if not positive:
        return None
    order = np.random.default_rng(11)
    negative = sorted(harmless)
    if len(negative) > _INSTANCES:
        negative = [negative[k] for k in sorted(order.choice(len(negative), _INSTANCES, replace=False))]
    landmarks = _spread(positive, LANDMARKS * 2 // 3)
    landmarks += [w for w in _spread(negative[:: max(1, len(negative) // 400)], LANDMARKS // 3) if w not in landmarks]
    values, vectors = np.linalg.eigh(subsequence_kernel(landmarks, landmarks))
    kept = values > 1e-6
    root = vectors[:, kept] / np.sqrt(values[kept])
    x_negative = subsequence_kernel(negative, landmarks) @ root
    model = None
    for _ in range(3):
        x = np.vstack([subsequence_kernel(positive, landmarks) @ root, x_negative])
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        w, bias = _fit_svm(x, y)
        model = ToxicityModel(_folded(landmarks, root @ w), bias, (1.0, 0.0))
        words = sorted(set().union(*toxic, *clean))
        margin = dict(zip(words, word_margins(model, words).tolist()))
        best = [max(bag, key=lambda w: (margin[w], w)) for bag in toxic if bag]
        positive = sorted({w for w in best if margin[w] > 0}) or positive
    top = [max(map(margin.__getitem__, b), default=model.bias) for b in [*toxic, *clean]]
    slope, cut = fit_logistic(np.array(top)[:, None], np.array([1.0] * len(toxic) + [0.0] * len(clean)))
    return ToxicityModel(model.table, model.bias, (float(slope), float(cut)))


def _spread(words: list[str], count: int) -> list[str]:
    """Words chosen one after the other, each as unlike the ones before as possible."""
    if len(words) <= count:
        return list(words)
    kernel = subsequence_kernel(words, words)
    chosen = [0]
    near = kernel[:, 0].copy()
    while len(chosen) < count:
        k = int(np.argmin(near))
        chosen.append(k)
        near = np.maximum(near, kernel[:, k])
    return [words[k] for k in chosen]


class _Scorer:
    """Margins of words with a cache per worker process."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model, self.known = model, {}

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        bags = [words_of(t) for t in texts]
        if len(self.known) > _CACHED:
            self.known.clear()
        fresh = list(set().union(*bags).difference(self.known)) if bags else []
        self.known.update(zip(fresh, word_margins(self.model, fresh).tolist()))
        get = self.known.__getitem__
        top = [max(map(get, bag), default=self.model.bias) for bag in bags]
        slope, cut = self.model.calibration
        return sigmoid(slope * np.array(top) + cut)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score (likelihood of label 1), predicted, for every row.

    Every word of the whole text is looked at. Null and empty texts get the score of a text
    without words; without enough labels of both classes every score is 0.0. Null ids and
    repeated rows are kept and scored each.
    """
    model = fit_toxicity(training_rows(docs, labels, "toxic", SAMPLE_ROWS))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(shared.value) if shared.value else None
        for batch in blocks(batches, 500):
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            values = scorer(texts) if scorer else np.zeros(len(texts))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": values})

    known = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id")
    scored = docs.select(known, "text").mapInPandas(score, "doc_id long, score double")
    scored = scored.withColumn("doc_id", F.expr(f"nullif(doc_id, {_NULL_ID})"))
    return scored.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
