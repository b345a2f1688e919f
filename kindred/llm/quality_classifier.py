"""Quality classifier: naive Bayes support vectors (NB-SVM).

Features are indicators of n-grams: words in lower case, and 1- to 3-grams of word shapes, where a
shape keeps case, digits and punctuation runs and a repeated word has a shape of its own. Each
indicator is scaled by the log-count ratio of its class counts, rows are scaled to length 1, and a
linear hinge-loss model is fitted by dual coordinate descent. A logistic curve over the margins of
rows that the model was not fitted on turns margins into scores.

The fit uses at most ``SAMPLE`` labelled rows a class, chosen by hash. Scoring is a map over whole
texts without any shuffle, with one broadcast array of 2^18 weights.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.learning import agreed, features_of, in_fold, sample, sigmoid
from kindred.llm.words import LOWER, UPPER, WORD

SAMPLE = 4000
BITS = 18
SIZE = 1 << BITS
FOLDS, HELD_OUT = 4, 2
MIN_COUNT = 5  # rarer features are left out
RECENT_WORDS = 1 << 17
TO_LOWER = str.maketrans(UPPER, LOWER)
SAME = crc32(b"same word again")
PUNCTUATION = re.compile(r"[\W_]+")


def shape(word: str) -> str:
    """Case or digits of the letters, and punctuation with runs cut to two."""
    core = PUNCTUATION.sub("", word)
    if not core:
        kind = ""
    elif core.isdigit():
        kind = "0"
    elif core.isupper():
        kind = "A" if len(core) > 1 else "C"
    elif core[:1].isupper() and core[1:].islower():
        kind = "C"
    else:
        kind = "a" if core.islower() else "m"
    marks = "".join(PUNCTUATION.findall(word))
    return kind + re.sub(r"(.)\1{2,}", r"\1\1", marks[:8])


class _Words(dict):
    """For each recent word, the hash of its lower-case form and that of its shape, packed."""

    def __missing__(self, word: str) -> int:
        if len(self) >= RECENT_WORDS:
            self.clear()
        low = crc32(word.translate(TO_LOWER).encode())
        packed = self[word] = (low & 0x7FFFFFFF) << 32 | crc32(shape(word).encode())
        return packed


def features() -> Callable[[str], np.ndarray]:
    """Turns a text into the sorted numbers of its features."""
    words_of, known = re.compile(WORD).findall, _Words()
    mix = np.uint64(0x9E3779B97F4A7C15)

    def gram(*parts: np.ndarray) -> np.ndarray:
        total = np.full(len(parts[-1]), len(parts), np.uint64)
        for part in parts:
            total = (total ^ part) * mix
            total ^= total >> np.uint64(29)
        return total >> np.uint64(64 - BITS)

    def find(text: str) -> np.ndarray:
        words = words_of(text)
        packed = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        low, shapes = packed >> np.uint64(32), packed & np.uint64(0xFFFFFFFF)
        shapes[1:][low[1:] == low[:-1]] = SAME
        grams = [gram(low + np.uint64(1 << 33)), gram(shapes)]
        grams += [gram(shapes[:-1], shapes[1:]), gram(shapes[:-2], shapes[1:-1], shapes[2:])]
        return np.unique(np.concatenate(grams)).astype(np.uint32)

    return find


@dataclass(frozen=True)
class Model:
    """Scaled weights by feature number, how rows are scaled, and the logistic curve."""

    ratios: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        scale = self.ratios[found]
        length = float(np.sqrt((scale * scale).sum()))
        return float(self.weights[found].sum()) / length if length else 0.0

    def score(self, found: np.ndarray) -> float:
        return float(sigmoid(np.float64(self.slope * self.margin(found) + self.offset)))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = np.zeros((2, SIZE))
    for row, label in zip(rows, labels):
        counts[label][row] += 1
    smooth = counts + 1
    ratios = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())
    ratios[counts.sum(0) < MIN_COUNT] = 0
    return ratios


def dual_coordinate_descent(
    rows: list[np.ndarray],
    values: list[np.ndarray],
    labels: np.ndarray,
    cost: float = 1.0,
    rounds: int = 12,
) -> np.ndarray:
    """Weights of the hinge-loss model; the costs of both classes weigh the same in total."""
    sign = np.where(labels == 1, 1.0, -1.0)
    share = np.array([(labels == 0).mean(), (labels == 1).mean()])
    costs = cost * 0.5 / share[labels]
    weights, dual = np.zeros(SIZE), np.zeros(len(rows))
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            row, value = rows[i], values[i]
            norm = float(value @ value)
            if not norm:
                continue
            slope = sign[i] * float(weights[row] @ value) - 1
            new = min(max(dual[i] - slope / norm, 0.0), costs[i])
            step = new - dual[i]
            if step:
                weights[row] += step * sign[i] * value
                dual[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return weights


def logistic_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with targets drawn in from 0 and 1, classes balanced."""
    n = np.bincount(labels, minlength=2)
    goal = np.where(labels == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    weigh = np.where(labels == 1, 0.5 / max(n[1], 1), 0.5 / max(n[0], 1))
    design = np.stack([margins, np.ones_like(margins)], 1)
    curve = np.zeros(2)
    for _ in range(50):
        p = sigmoid(design @ curve)
        gradient = design.T @ (weigh * (p - goal)) + 1e-6 * curve
        bend = (design * (weigh * p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        step = np.linalg.solve(bend, gradient)
        curve -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(curve[0]), float(curve[1])


def fit(found: list[np.ndarray], labels: np.ndarray) -> Model:
    """A model from rows of feature numbers; a flat one where a class is missing."""
    if len(set(labels.tolist())) < 2:
        only = float(labels[0]) if len(labels) else 0.5
        offset = {0.0: -2.0, 0.5: 0.0, 1.0: 2.0}[only]
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0, offset)
    last = np.arange(len(labels)) % 4 == 3
    if min(np.bincount(labels[~last], minlength=2)) == 0 or len(set(labels[last].tolist())) < 2:
        last = np.zeros(len(labels), bool)
    kept = [row for row, out in zip(found, last) if not out]
    ratios = log_count_ratios(kept, labels[~last])

    def scaled(row: np.ndarray) -> np.ndarray:
        value = ratios[row]
        return value / (np.sqrt(value @ value) or 1.0)

    plain = dual_coordinate_descent(kept, [scaled(row) for row in kept], labels[~last])
    model = Model(ratios, plain * ratios, 1.0, 0.0)
    rest = last if last.any() else ~last
    margins = np.array([model.margin(row) for row, out in zip(found, rest) if out])
    return Model(ratios, plain * ratios, *logistic_curve(margins, labels[rest]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", size: int = SAMPLE) -> Model:
    """Fits on at most ``size`` labelled rows of each class outside the held-out fold."""
    known = agreed(labels, label).filter(~in_fold(F.col("doc_id"), FOLDS, HELD_OUT))
    chosen = sample(known.filter("label = 0"), size).unionAll(
        sample(known.filter("label = 1"), size)
    )
    rows = features_of(docs, chosen, features)
    return fit([row for _, _, row in rows], np.array([label for _, label, _ in rows], int))


def score(spark: SparkSession, model: Model, text: Column) -> Column:
    """The score of each text; the model is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ready = shared.value
        find = features()
        for texts in batches:
            yield pd.Series([ready.score(find(text or "")) for text in texts], dtype=float)

    return scores(text)


def classify(
    docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1) and predicted.

    NULL and empty texts have no features and get the score of a margin of 0. A NULL id is never
    held out. Documents whose label rows disagree are not learned from; without any label of one
    class every score is the same, on the side of the class there is. Repeated rows get the same
    score, an empty table an empty result, and other columns are not read.
    """
    model = train(docs, labels, label)
    scored = docs.select("doc_id", score(docs.sparkSession, model, F.col("text")).alias("score"))
    return scored.select(
        "doc_id",
        in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )
