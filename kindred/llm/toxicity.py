"""Toxicity: non-negative positive-unlabelled (nnPU) learning.

Learns from texts confirmed as toxic and from unlabelled texts of which an unknown part is toxic.
With the class prior p, the risk of the clean class is the unlabelled risk less p times that of
the positives counted as clean; it can't be below 0, so once its estimate is, the step goes the
other way, which stops overfitting. Features are words in lower case and their first 4, 5 and 6
characters; only those that positives hold clearly more often than unlabelled texts are used, so
that long clean texts don't gather a score. Several classifiers with their own shares of the
unlabelled texts are averaged.

Positives are a sample of at most ``positives`` texts, chosen by hash of distinct ids. Of the
unlabelled side nothing is sampled. Every text is cut into words once, by a map that writes which
candidate features (those of positives) it holds. From that table come the clean shares, over all
unlabelled documents; the rows to fit on; and, as a sum of weights, every score. The fit sees all
unlabelled documents as weighted rows: documents of one member whose surest chosen feature and
number of chosen features agree are one cell, given by their number and their mean. Documents with
no or one chosen feature, by far the most, are exactly their cell. There are at most ``MEMBERS`` *
(``FEATURES`` * ``SIZES`` + 1) cells, however many documents there are. The prior is the share of
toxic rows among all labels outside the held-out fold.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.arrow import map_slices
from kindred.llm.learning import agreed, features_of, in_fold, sample, sigmoid
from kindred.llm.words import LOWER, UPPER, WORD, written

POSITIVES = 2500
FEATURES = 1024
MEMBERS = 3
SIZES = 3  # numbers of chosen features told apart in cells: 1, 2 to 3, more
FOLDS, HELD_OUT = 3, 1
SPACE = 1 << 22
PREFIXES = (4, 5, 6)
RECENT_WORDS = 1 << 17
TO_LOWER = str.maketrans(UPPER, LOWER)
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def word_features(word: str) -> set[int]:
    core = EDGES.sub("", word.translate(TO_LOWER))
    if not core:
        return set()
    parts = {core} | {core[:size] + "~" for size in PREFIXES if len(core) >= size}
    return {crc32(part.encode()) % SPACE for part in parts}


class _Recent(dict):
    """Features of recent words, restricted to chosen ones if given."""

    def __init__(self, chosen: dict[int, int] | None = None):
        super().__init__()
        self.chosen = chosen

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= RECENT_WORDS:
            self.clear()
        found = word_features(word)
        if self.chosen is not None:
            found = {self.chosen[number] for number in found if number in self.chosen}
        kept = self[word] = tuple(found)
        return kept


def features(chosen: dict[int, int] | None = None) -> Callable[[str], np.ndarray]:
    """Turns a text into the sorted numbers of its features."""
    words_of, recent = re.compile(WORD).findall, _Recent(chosen)

    def find(text: str) -> np.ndarray:
        found = set().union(*filter(None, map(recent.__getitem__, words_of(text))))
        return np.array(sorted(found), np.uint32)

    return find


@dataclass(frozen=True)
class Model:
    """Chosen features with their places, and a row of weights and an offset per member."""

    chosen: dict[int, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1, 0)))
    offsets: np.ndarray = field(default_factory=lambda: np.full(1, -4.0))

    def score(self, found: np.ndarray) -> float:
        return float(sigmoid(self.weights[:, found].sum(1) + self.offsets).mean())


def candidates(positive: list[np.ndarray]) -> tuple[dict[int, int], np.ndarray]:
    """Features that enough positives hold, with their places, and how many hold each.

    One in a hundred positives must have it, so that the words of one much copied text are no
    feature.
    """
    count = np.zeros(SPACE, np.int32)
    for row in positive:
        count[row] += 1
    found = np.flatnonzero(count >= max(3, 0.01 * len(positive)))
    return {int(number): place for place, number in enumerate(found)}, count[found]


def choose(
    positive: list[np.ndarray],
    known: tuple[dict[int, int], np.ndarray],
    mixed: np.ndarray,
    documents: int,
    prior: float,
) -> dict[int, int]:
    """Features far more frequent in positives than in clean texts, the surest first.

    ``mixed`` says how many of all unlabelled documents hold each candidate. The clean share is the
    unlabelled share less the positives' part of it. How sure a feature is follows from a Poisson
    tail: its count in positives against the count that the clean share makes likely.
    """
    numbers, count = known
    share = count / len(positive)
    clean = np.maximum(mixed / documents - prior * share, 0) / (1 - prior) + 1 / documents
    usual = clean * len(positive)
    sure = count * np.log(count / usual) - (count - usual)
    sure[share < 5 * clean] = 0
    best = np.argsort(-sure, kind="stable")[:FEATURES]
    bar = 3.5 * np.log(len(positive) + 1)  # more positives hold more words that could pass by chance
    number_of = list(numbers)
    return {number_of[at]: place for place, at in enumerate(best[sure[best] > bar])}


def non_negative_fit(
    positive: np.ndarray, unlabelled: np.ndarray, documents: np.ndarray, prior: float, steps: int = 400
) -> tuple[np.ndarray, float]:
    """Weights and offset that minimise the non-negative risk under the logistic loss.

    Each row of ``unlabelled`` stands for a number of documents.
    """
    width = positive.shape[1]
    params = np.zeros(width + 1)
    params[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(params), np.zeros_like(params)
    each, share = np.full(len(positive), 1 / len(positive)), documents / documents.sum()

    def gradient(rows: np.ndarray, errors: np.ndarray) -> np.ndarray:
        return np.append(rows.T @ errors.astype(np.float32), errors.sum())

    for step in range(1, steps + 1):
        line = params[:-1].astype(np.float32)
        z_p, z_u = (rows @ line + params[-1] for rows in (positive, unlabelled))
        as_clean = share @ np.logaddexp(0, z_u) - prior * (each @ np.logaddexp(0, z_p))
        clean = gradient(unlabelled, share * sigmoid(z_u)) - prior * gradient(positive, each * sigmoid(z_p))
        if as_clean >= 0:
            slope = clean + prior * gradient(positive, each * (sigmoid(z_p) - 1))
            slope[:-1] += 1e-4 * params[:-1]
        else:
            slope = -clean
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        params -= (
            0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        )
    return params[:-1], float(params[-1])


def fit(
    positive: list[np.ndarray], members: list[tuple[np.ndarray, np.ndarray]], chosen: dict[int, int], prior: float
) -> Model:
    """A model from positives' feature numbers and each member's cells: rows of means, documents."""
    rows = np.zeros((len(positive), len(chosen)), np.float32)
    for row, found in zip(rows, positive):
        row[[chosen[n] for n in found.tolist() if n in chosen]] = 1
    fitted = [non_negative_fit(rows, *cells, prior) for cells in members if len(cells[1])]
    return Model(chosen, np.stack([m[0] for m in fitted]), np.array([m[1] for m in fitted]))


def is_open(doc_id: Column) -> Column:
    """Outside the held-out fold: all such documents count as unlabelled."""
    return doc_id.isNotNull() & ~in_fold(doc_id, FOLDS, HELD_OUT)


def held_features(docs: DataFrame, numbers: dict[int, int]) -> DataFrame:
    """doc_id and ``found``, the places of the features that the text holds, written once for all
    that follows. This is the only pass over the texts.

    ``found`` has the steps from place to place, in two bytes each where that is enough.
    """
    kind = step_kind(len(numbers))

    def make():
        find = features(numbers)

        def rows(batch: pa.RecordBatch) -> dict:
            places = [find(text or "").astype(np.int64) for text in batch["text"].to_pylist()]
            return {"doc_id": batch["doc_id"], "found": [np.diff(p, prepend=0).astype(kind).tobytes() for p in places]}

        return rows

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(map_slices(texts, make, "doc_id bigint, found binary"), "toxic-features", "zstd")


def step_kind(places: int) -> str:
    return "<u2" if places <= 1 << 16 else "<u4"


def unlabelled(held: DataFrame) -> DataFrame:
    """doc_id and features of each unlabelled document; of rows with one id, that with the
    smallest list counts."""
    rows = held.filter(is_open(F.col("doc_id")))
    return written(rows.groupBy("doc_id").agg(F.min("found").alias("found")), "toxic-unlabelled", "zstd")


def _flat(found: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All places of some rows one after the other, and the row of each."""
    sizes = np.array([len(one) for one in found], np.int64) // np.dtype(kind).itemsize
    rows = np.repeat(np.arange(len(found)), sizes)
    sums = np.append(0, np.cumsum(np.frombuffer(b"".join(found), kind).astype(np.int64)))
    return rows, sums[1:] - np.repeat(sums[np.cumsum(sizes) - sizes], sizes)


def _counted(rows: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray]) -> dict[int, int]:
    """How often each key occurs; tasks count before the shuffle, the keys are of bounded number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def counted() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["key", "n"])

        for batch in batches:
            waiting.append(keys(batch))
            size += waiting[-1].size
            if size > 1 << 22:
                yield counted()
                waiting, size = [], 0
        if waiting:
            yield counted()

    counts = rows.mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(counts["key"].to_pylist(), counts["n"].to_pylist()))


def holders(documents: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """How many documents hold each feature, by its place, and how many there are."""

    kind = step_kind(width)

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        _, places = _flat(batch["found"].to_pylist(), kind)
        return np.append(places, np.full(batch.num_rows, width))

    counts = _counted(documents, keys)
    return np.array([counts.get(place, 0) for place in range(width)], np.int64), counts.get(width, 0)


def cells(documents: DataFrame, column_of: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each member's unlabelled documents as rows of means over the chosen features, with the
    number of documents of each row.

    ``column_of`` has the column of each place among ``width`` chosen features, surest first, or
    -1.
    """
    stride, kind = width + 1, step_kind(len(column_of))

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        member = np.array([crc32(str(i).encode()) // FOLDS % MEMBERS for i in batch["doc_id"].to_pylist()], np.int64)
        rows, places = _flat(batch["found"].to_pylist(), kind)
        columns = column_of[places]
        rows, columns = rows[columns >= 0], columns[columns >= 0]
        number = np.bincount(rows, minlength=batch.num_rows)
        surest = np.full(batch.num_rows, width)
        np.minimum.at(surest, rows, columns)
        size = np.minimum(np.log2(np.maximum(number, 1)).astype(np.int64), SIZES - 1)
        cell = (member * stride + surest) * SIZES + size
        return np.append(cell[rows] * stride + columns, cell * stride + width)

    counts = _counted(documents, keys)
    members: list[tuple[np.ndarray, np.ndarray]] = []
    for member in range(MEMBERS):
        own = sorted(key for key in counts if key // stride // SIZES // stride == member)
        place = {cell: row for row, cell in enumerate(sorted({key // stride for key in own}))}
        table = np.zeros((len(place), stride), np.float64)
        for key in own:
            table[place[key // stride], key % stride] = counts[key]
        documents_of = table[:, width]
        members.append(((table[:, :width] / documents_of[:, None]).astype(np.float32), documents_of))
    return members


@dataclass(frozen=True)
class Trained:
    """A model, and the table of held features of the documents it was trained on."""

    model: Model
    held: DataFrame | None = None
    column_of: np.ndarray | None = None


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", positives: int = POSITIVES) -> Trained:
    """Fits on at most ``positives`` positives and all unlabelled documents outside the held-out
    fold; without positives nothing is toxic."""
    known = agreed(labels, label).filter(~in_fold(F.col("doc_id"), FOLDS, HELD_OUT))
    prior = known.agg(F.avg("label")).first()[0] or 0.0
    prior = min(max(prior, 0.001), 0.9)
    rows = features_of(docs, sample(known.filter("label = 1"), positives), features)
    positive = [found for _, _, found in rows]
    if not positive:
        return Trained(Model())
    found = candidates(positive)
    held = held_features(docs, found[0])
    documents = unlabelled(held)
    chosen = choose(positive, found, *holders(documents, len(found[0])), prior)
    column_of = np.full(len(found[0]), -1, np.int64)
    for number, column in chosen.items():
        column_of[found[0][number]] = column
    model = fit(positive, cells(documents, column_of, len(chosen)), chosen, prior)
    return Trained(model, held, column_of)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", positives: int = POSITIVES) -> Model:
    return learn(docs, labels, label, positives).model


def held_scores(trained: Trained) -> DataFrame:
    """doc_id and score of the documents that were trained on, from the features they hold."""
    model, column_of = trained.model, trained.column_of
    kind = step_kind(len(column_of))

    def make():
        def score(batch: pa.RecordBatch) -> dict:
            rows, places = _flat(batch["found"].to_pylist(), kind)
            columns = column_of[places]
            rows, columns = rows[columns >= 0], columns[columns >= 0]
            total = np.zeros(batch.num_rows)
            for weights, offset in zip(model.weights, model.offsets):
                margin = np.bincount(rows, weights[columns], minlength=batch.num_rows)
                total += sigmoid(margin + offset)
            return {"doc_id": batch["doc_id"], "score": total / len(model.offsets)}

        return score

    return map_slices(trained.held, make, "doc_id bigint, score double", 4096)


def score(spark: SparkSession, model: Model, text: Column) -> Column:
    """The score of each text; the model is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ready = shared.value
        find = features(ready.chosen)
        for texts in batches:
            yield pd.Series([ready.score(find(text or "")) for text in texts], dtype=float)

    return scores(text)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    threshold: float = 0.7,
    positives: int = POSITIVES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1) and predicted.

    ``positives`` bounds the sample of confirmed texts that the fit takes. NULL and empty texts
    have no features and get the score of the offset, which is low. A NULL id is never held out.
    Documents whose label rows disagree are no positives; without positives nothing is toxic.
    Repeated rows get the same score, an empty table an empty result, and other columns are not
    read.
    """
    trained = learn(docs, labels, label, positives)
    if trained.held is None:
        flat = trained.model.score(np.empty(0, np.int64))
        scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(flat).alias("score"))
    else:
        scored = held_scores(trained)
    return scored.select(
        "doc_id",
        in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )
