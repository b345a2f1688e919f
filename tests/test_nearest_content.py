"""Similar items of all items by bounds against all pairs, and against the scan for one item."""

from __future__ import annotations

import math
import random

import pytest

from kindred.operators import content, nearest_content

VECTORS = nearest_content.VECTOR


def norm(numbers, shared):
    return math.sqrt(sum(x * x for x in numbers) + len(shared))


def plain(rows, k):
    out = set()
    for item, numbers, shared, own in rows:
        scored = []
        for other, numbers2, shared2, own2 in rows:
            if other != item:
                dot = sum(x * y for x, y in zip(numbers, numbers2)) + len(set(shared) & set(shared2))
                cosine = dot / (own * own2) if own * own2 else 0.0
                scored.append((-math.floor(cosine * 1000 + 0.5), other))
        out |= {(item, other, -minus, rank) for rank, (minus, other) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.fixture(scope="module")
def rows():
    """A third of the items are alike; one value is in most items; some have no attribute."""
    draw, out = random.Random(21), []
    for item in range(400):
        if item % 3 == 0:
            numbers, shared = [0.5, 0.25], ["a=1", "b=1"]
        else:
            numbers = [draw.randint(0, 8) / 8 for _ in range(2)]
            shared = [f"a={draw.randint(1, 6)}", *(["b=1"] if draw.random() < 0.7 else []), *([f"c={item % 9}"] if item % 2 else [])]
        if item % 50 == 7:
            numbers, shared = [0.0, 0.0], []
        out.append((item, numbers, shared, norm(numbers, shared)))
    draw.shuffle(out)
    return out


@pytest.mark.parametrize("k, block, part", [(10, 16, 2048), (3, 50, 20), (1, 7, 2048), (10, 1024, 2048)])
def test_all_items(spark, rows, monkeypatch, k, block, part):
    monkeypatch.setattr(nearest_content, "PART_ITEMS", part)
    best, met = nearest_content.similar_items(spark.createDataFrame(rows, VECTORS), k, block_items=block)
    assert {tuple(row) for row in best.collect()} == plain(rows, k)
    assert {row["n_blocks"] for row in met.collect()} == {-(-400 // block)}
    assert met.count() == 400


def test_most_blocks_are_not_met(spark, rows):
    _, met = nearest_content.similar_items(spark.createDataFrame(rows, VECTORS), 3, block_items=16)
    found = met.collect()
    assert sum(row["met"] for row in found) < 0.5 * sum(row["n_blocks"] for row in found)


def test_the_same_as_one_item_at_a_time(spark, rows):
    frame = spark.createDataFrame(rows, VECTORS)
    best, _ = nearest_content.similar_items(frame, 10, block_items=32)
    found = best.collect()
    for item in (0, 7, 100, 399):
        want = content.similar_by_vectors(frame, item, 10).collect()
        mine = sorted((r["rank"], r["other_id"], r["score"]) for r in found if r["item_id"] == item)
        assert [(o, s) for _, o, s in mine] == [(r["other_id"], r["score"]) for r in want]


def test_few_items(spark):
    one = [(1, [1.0], ["a=1"], 2**0.5)]
    for rows in ([], one, one + [(2, [0.0], [], 0.0)]):
        best, _ = nearest_content.similar_items(spark.createDataFrame(rows, VECTORS), 5)
        assert {tuple(row) for row in best.collect()} == plain(rows, 5)
    bare = [(n, [], ["a=1"], 1.0) for n in range(4)]
    best, _ = nearest_content.similar_items(spark.createDataFrame(bare, VECTORS), 2, block_items=2)
    assert {tuple(row) for row in best.collect()} == plain(bare, 2)


def test_like_items_meet_near_blocks_alone(spark, monkeypatch):
    """Items with the same values meet the blocks that their numbers are near to, and copies those
    with the smallest ids; blocks grow before there are too many of them."""
    draw, out = random.Random(4), []
    for item in range(1200):
        numbers = [0.5, 0.5] if item % 4 == 0 else [draw.random(), draw.random()]
        out.append((item, numbers, [f"a={item % 2}"], norm(numbers, ["a"])))
    frame, few = spark.createDataFrame(out, VECTORS), 5
    best, met = nearest_content.similar_items(frame, few, block_items=16)
    assert {tuple(row) for row in best.collect()} == plain(out, few)
    found = met.collect()
    assert sum(row["met"] for row in found) < 0.1 * sum(row["n_blocks"] for row in found)
    monkeypatch.setattr(nearest_content, "FEW_BLOCKS", 20)
    best, met = nearest_content.similar_items(frame, few, block_items=16)
    assert {tuple(row) for row in best.collect()} == plain(out, few)
    assert {row["n_blocks"] for row in met.collect()} == {20}
