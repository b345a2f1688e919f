"""The two classifiers against plain versions that see all rows on one machine."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import quality_classifier, toxicity

DOCS = "doc_id bigint, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus():
    """Texts with a few bad words, a third of them copies of one; half of the toxic ones labelled."""
    draw = random.Random(17)
    usual, bad = [f"word{n}" for n in range(400)], [f"Vile{n}!" for n in range(12)]
    rows, labels = [], []
    for doc_id in range(900):
        toxic = doc_id % 6 == 0
        words = draw.choices(usual, k=draw.randint(3, 60))
        if toxic:
            words += draw.sample(bad, 4)
        elif doc_id % 50 == 1:
            words.append(bad[0])
        rows.append((doc_id, "the very same text" if doc_id % 3 == 1 else " ".join(words)))
        if toxic and doc_id % 12 == 0 or doc_id % 4 == 1:
            labels.append((doc_id, int(not toxic), int(toxic and doc_id % 3 != 1)))
    return rows, labels


@pytest.fixture(scope="module")
def frames(spark, corpus):
    rows, labels = corpus
    docs = rows + rows[:30] + [(None, "no id Vile1! Vile2!"), (2000, None), (2001, "")]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def word_features(text):
    found = set()
    for word in WORD.findall(text or ""):
        core = re.sub(r"^[\W_]+|[\W_]+$", "", "".join(c.lower() if c.isascii() else c for c in word))
        for part in {core, *(core[:n] + "~" for n in (4, 5, 6) if len(core) >= n)} if core else ():
            found.add(crc32(part.encode()) % toxicity.SPACE)
    return found


def open_ids(ids):
    return [i for i in ids if crc32(str(i).encode()) % 3 != 1]


def plain_toxicity(rows, labels):
    """Weights by place and scores, from sets of features and cells in plain dictionaries."""
    texts = dict(rows) | {2000: None, 2001: ""}
    found = {i: word_features(text) for i, text in texts.items()}
    known = {i: toxic for i, _, toxic in labels if i in set(open_ids(texts))}
    prior = sum(known.values()) / len(known)
    positive = [found[i] for i in sorted(i for i, toxic in known.items() if toxic)]
    held = Counter(n for row in positive for n in row)
    numbers = sorted(n for n, count in held.items() if count >= max(3, 0.01 * len(positive)))
    mixed = Counter(n for i in open_ids(texts) for n in found[i])
    place = {n: k for k, n in enumerate(numbers)}
    chosen = toxicity.choose(
        [np.array(sorted(row)) for row in positive],
        (place, np.array([held[n] for n in numbers])),
        np.array([mixed[n] for n in numbers]), len(open_ids(texts)), prior,
    )
    cells = [defaultdict(list) for _ in range(3)]
    for i in open_ids(texts):
        columns = sorted(chosen[n] for n in found[i] if n in chosen)
        key = (columns[0] if columns else len(chosen), min(len(columns).bit_length() - 1, 2) if columns else 0)
        cells[crc32(str(i).encode()) // 3 % 3][key].append(columns)

    def dense(rows):
        table = np.zeros((len(rows), len(chosen)), np.float32)
        for line, columns in zip(table, rows):
            line[list(columns)] = 1
        return table

    matrix = dense([[chosen[n] for n in row if n in chosen] for row in positive])
    fitted = []
    for member in cells:
        keys = sorted(member)
        means = np.array([dense(member[key]).astype(float).mean(0) for key in keys], np.float32)
        sizes = np.array([len(member[key]) for key in keys], float)
        fitted.append(toxicity.non_negative_fit(matrix, means, sizes, prior))

    def score(text):
        columns = [chosen[n] for n in word_features(text) if n in chosen]
        return np.mean([1 / (1 + np.exp(-(w[columns].sum() + b))) for w, b in fitted])

    return score, chosen, sum(len(member) for member in cells)


def test_toxicity_against_a_plain_version(corpus, frames):
    docs, labels = frames
    score, chosen, n_cells = plain_toxicity(*corpus)
    assert len(chosen) >= 12 and n_cells < 300
    texts = docs.toPandas()
    found = toxicity.classify(docs, labels).collect()
    want = Counter((None if i != i else int(i), round(score(text), 6)) for i, text in zip(texts["doc_id"], texts["text"]))
    assert Counter((row["doc_id"], round(row["score"], 6)) for row in found) == want
    toxic = {i: i % 6 == 0 and i % 3 != 1 for i, _ in corpus[0]}
    held_out = [row for row in found if row["held_out"]]
    assert {row["doc_id"] for row in held_out} == {i for i in [*toxic, 2000, 2001] if crc32(str(i).encode()) % 3 == 1}
    assert np.mean([row["predicted"] == toxic.get(row["doc_id"], False) for row in held_out]) > 0.95


def test_scores_of_odd_rows(frames):
    """Repeated rows score alike; NULL and empty texts as a text without features."""
    docs, labels = frames
    for module in (toxicity, quality_classifier):
        scores = defaultdict(set)
        found = module.classify(docs, labels).collect()
        assert len(found) == docs.count()
        for row in found:
            scores[row["doc_id"]].add(row["score"])
        assert all(len(values) == 1 for values in scores.values())
        assert scores[2000] == scores[2001]
        assert not any(row["held_out"] for row in found if row["doc_id"] is None)
    model = toxicity.train(docs, labels)
    (row,) = toxicity.classify(docs, labels).filter("doc_id = 2001").collect()
    assert row["score"] == pytest.approx(model.score(np.empty(0, int))) and row["score"] < 0.5


def test_score_of_new_texts(spark, frames):
    """The column of scores for texts that the model has not seen agrees with classify."""
    docs, labels = frames
    column = toxicity.score(spark, toxicity.train(docs, labels), F.col("text"))
    new = {row["doc_id"]: row["s"] for row in docs.select("doc_id", column.alias("s")).collect()}
    for row in toxicity.classify(docs, labels).collect():
        assert row["score"] == pytest.approx(new[row["doc_id"]], abs=1e-9)


def test_all_unlabelled_documents_count(spark):
    """An id counts once however often it is repeated, and no document is left out."""
    texts = {i: f"word{i % 7} common and" + " rare" * (i % 11 == 0) for i in range(300)}
    frame = spark.createDataFrame(
        [(i, text) for i, text in texts.items() for _ in range(40 if i % 5 == 0 else 1)], DOCS
    )
    numbers = {n: at for at, n in enumerate(sorted(toxicity.word_features("rare") | toxicity.word_features("word3")))}
    documents = toxicity.unlabelled(toxicity.held_features(frame, numbers))
    used = open_ids(texts)
    held, n = toxicity.holders(documents, len(numbers))
    want = Counter(numbers[f] for i in used for f in word_features(texts[i]) if f in numbers)
    assert n == len(used) and held.tolist() == [want[at] for at in range(len(numbers))]
    columns = np.arange(len(numbers))
    members = toxicity.cells(documents, columns, len(numbers))
    assert sum(sizes.sum() for _, sizes in members) == len(used)
    total = sum(sizes @ rows for rows, sizes in members)
    assert np.round(total).astype(int).tolist() == held.tolist()


def test_non_negative_risk():
    """The steps go down the risk, and its clean part does not fall below zero by much."""
    draw = np.random.default_rng(5)
    positive = (draw.random((200, 8)) < [0.6] * 4 + [0.3] * 4).astype(np.float32)
    rows = np.vstack([positive[:40], (draw.random((360, 8)) < [0.02] * 4 + [0.3] * 4).astype(np.float32)])
    single = toxicity.non_negative_fit(positive, rows, np.ones(len(rows)), 0.1)
    distinct, counts = np.unique(rows, axis=0, return_counts=True)
    merged = toxicity.non_negative_fit(positive, distinct, counts, 0.1)
    assert np.allclose(single[0], merged[0], atol=1e-2) and single[1] == pytest.approx(merged[1], abs=1e-2)
    assert (single[0][:4] > np.abs(single[0][4:]).max()).all()


def plain_quality(rows, labels):
    """The fit of the library's own arithmetic on features from a plain loop."""
    texts, find = dict(rows), quality_classifier.features()
    known = {i: q for i, q, _ in labels if crc32(str(i).encode()) % 4 != 2}
    ids = sorted(known)
    model = quality_classifier.fit([find(texts[i]) for i in ids], np.array([known[i] for i in ids]))
    return lambda text: model.score(find(text or ""))


def test_quality_against_a_plain_version(corpus, frames):
    docs, labels = frames
    score, texts = plain_quality(*corpus), docs.toPandas()
    want = Counter((None if i != i else int(i), round(score(text), 6)) for i, text in zip(texts["doc_id"], texts["text"]))
    found = quality_classifier.classify(docs, labels).collect()
    assert Counter((row["doc_id"], round(row["score"], 6)) for row in found) == want


def test_dual_coordinate_descent_meets_its_optimum():
    """At the optimum of the hinge loss no dual variable can move."""
    draw = random.Random(2)
    rows = [np.array(sorted(draw.sample(range(30), 6))) for _ in range(80)]
    labels = np.array([int(0 in row or 1 in row or 2 in row) for row in rows])
    values = [np.ones(6) / 6**0.5] * len(rows)
    weights = quality_classifier.dual_coordinate_descent(rows, values, labels, rounds=400)

    def loss(line):
        sign = np.where(labels == 1, 1, -1)
        cost = 0.5 / np.array([(labels == 0).mean(), (labels == 1).mean()])[labels]
        margins = sign * np.array([line[row] @ value for row, value in zip(rows, values)])
        return 0.5 * line @ line + cost @ np.maximum(0, 1 - margins)

    best = loss(weights)
    for _ in range(200):
        step = np.zeros_like(weights)
        step[:30] = np.random.default_rng(_).normal(0, 0.05, 30)
        assert loss(weights + step) >= best - 1e-3
