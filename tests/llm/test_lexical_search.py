"""Search by signatures against a plain scan; bounds that never fall below a score."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import lexical_search as search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def terms(text):
    lower = {upper: upper + 32 for upper in range(65, 91)}
    return TERM.findall((text or "").translate(lower))


def plain(docs, items, k):
    """(item, rank, doc_id, score) by scoring every document."""
    counts = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    n_docs, n_words = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(term for _, c in counts for term in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc_id, c in counts:
            m = 50 + 50 * sum(c.values()) * n_docs // n_words if c else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
                for t in wanted
                if c[t]
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (minus, missing, doc_id) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, None if missing else doc_id, -minus))
    return sorted(out, key=repr)


def found(spark, docs, items, k, **more):
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    frames = [frame.withColumns({n: F.lit("x") for n in ("term", "items", "score", "df", "known")}) for frame in frames]
    return sorted(map(tuple, search.search(*frames, k=k, **more).collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(8)
    words = [f"w{n}" for n in range(300)] + ["Ünï", "漢字", "x1"]
    weights = [1 / (n + 1) for n in range(len(words))]
    docs = [(n, " ".join(draw.choices(words, weights, k=draw.choice([1, 5, 40, 40, 300])))) for n in range(600)]
    items = [(n, ", ".join(draw.choices(words, k=draw.choice([1, 4, 30])))) for n in range(12)]
    return docs, items


@pytest.mark.parametrize("k, block_terms", [(50, 1 << 15), (3, 1 << 15), (1, 10), (1000, 40)])
def test_search(spark, corpus, k, block_terms):
    docs, items = corpus
    assert found(spark, docs, items, k, block_terms=block_terms) == plain(docs, items, k)


def test_small_groups(spark, corpus, monkeypatch):
    """Signatures that are dense, in groups of a few documents."""
    monkeypatch.setattr(search, "BITS_PER_ENTRY", 2)
    monkeypatch.setattr(search, "GROUP_ENTRIES", 64)
    docs, items = corpus
    assert found(spark, docs, items, 5) == plain(docs, items, 5)


def test_ties_copies_and_nulls(spark):
    copies = [(n, "The same words, the SAME words") for n in range(40, 0, -1)]
    odd = [(None, "same words"), (None, None), (7, "same words"), (7, "same words"), (8, ""), (9, " \n.;"), (10, "é" * 50_000)]
    items = [(1, "words same"), (1, "other"), (None, "the"), (2, None), (3, ""), (4, "absent"), (5, "é" * 50_000)]
    docs = copies + odd
    assert found(spark, docs, items, 10) == plain(docs, items, 10)
    assert found(spark, docs, items, 100) == plain(docs, items, 100)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")], 5) == []
    assert found(spark, [(1, "a")], [], 5) == []
    assert found(spark, [(1, None), (2, ".")], [(1, "a")], 5) == []


def test_bounds_hold(corpus):
    """No document's score is above its bound, and most bounds are met."""
    docs, items = corpus
    writer, groups = search.GroupWriter(), []
    counts = {doc_id: Counter(t.encode() for t in terms(text)) for doc_id, text in docs}
    items = [(item, [t.encode() for t in terms(text)]) for item, text in items]
    for doc_id, c in counts.items():
        groups.append(writer.add(doc_id, c))
    groups = [group for group in [*groups, *writer.rest()] if group]
    assert sum(group["n_docs"] for group in groups) == len(docs)
    df = Counter(t for c in counts.values() for t in c)
    asked = sorted({t for _, found in items for t in found if df[t]})
    place = {t: n for n, t in enumerate(asked)}
    block = search.Block(
        asked,
        np.array([math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) for t in asked]),
        [np.array(sorted({place[t] for t in found if df[t]}), int) for _, found in items],
        (sum(sum(c.values()) for c in counts.values()), len(docs)),
    )
    hashes = np.array([search.xxhash.xxh3_64_intdigest(t) for t in asked], np.uint64)
    equal = pairs = 0
    for group in groups:
        bounds = search.upper_bounds(block, group, hashes)
        for column, doc_id in enumerate(np.frombuffer(group["ids"], "<i8").tolist()):
            c = counts[doc_id]
            for item in range(len(items)):
                score = block.score(item, c, int(block.sizes(sum(c.values()))))
                assert bounds[item, column] >= score
                equal += bounds[item, column] == score
                pairs += 1
    assert equal > 0.5 * pairs


def test_few_documents_are_scored(spark, corpus):
    """The bar excludes most documents without a look at their texts."""
    docs, items = corpus
    frame = spark.createDataFrame(docs, DOCS)
    index = search.build_index(frame)
    known = search.item_terms(spark.createDataFrame(items, ITEMS))
    weighed = known.join(index.holders(known), "term").select("item_id", "term", search.weight(F.col("df"), index.documents).alias("weight"))
    block, item_ids = search._block(weighed, index)
    bars = {row[0]: row for row in plain(docs, items, 3) if row[1] == 3}
    limits = [(bars[item][3], bars[item][2]) if item in bars else (0, search.NO_ID) for item in item_ids]
    left = search.not_excluded(index.groups, block, limits).count()
    assert left < 0.2 * len(docs) * len(items)
