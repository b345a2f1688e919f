"""Largest inner products by bounded blocks against all products."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import factorize, products

USERS, ITEMS = "user_id bigint, vector array<double>", "item_id bigint, vector array<double>"


def plain(users, items, seen, k):
    out = set()
    for user, u in users:
        scored = sorted((-float(np.dot(u, v)), item) for item, v in items if (user, item) not in seen)
        out |= {(user, item, -score, rank) for rank, (score, item) in enumerate(scored[:k], 1)}
    return out


def found(spark, users, items, seen, k, **more):
    best, looked = products.largest_products(
        spark.createDataFrame(users, USERS), spark.createDataFrame(items, ITEMS),
        spark.createDataFrame(sorted(seen), "user_id bigint, item_id bigint"), k, **more,
    )
    return {tuple(row) for row in best.collect()}, looked.collect()


@pytest.fixture(scope="module")
def rows():
    """Whole numbers, so that sums are exact; lengths fall like a power; user 0 has seen most."""
    draw = np.random.default_rng(9)
    users = [(n, draw.integers(-9, 10, 6).astype(float).tolist()) for n in range(80)]
    items = [(n, (draw.integers(-9, 10, 6) * (1 + 4000 // (n + 8))).astype(float).tolist()) for n in range(700)]
    seen = {(0, n) for n in range(0, 700, 1) if n % 50} | {(n, int(i)) for n in range(80) for i in draw.integers(0, 700, 40)}
    users = [(n, v if any(v) else [1.0] * 6) for n, v in users]
    items = [(n, v if any(v) else [1.0] * 6) for n, v in items]
    return users, items, seen


@pytest.mark.parametrize("k, block", [(10, 16), (1, 100), (5, 2048)])
def test_products(spark, rows, k, block):
    users, items, seen = rows
    best, looked = found(spark, users, items, seen, k, block_items=block)
    assert best == plain(users, items, seen, k)
    assert {row["n_blocks"] for row in looked} == {-(-700 // block)}


def test_most_blocks_are_skipped(spark, rows):
    users, items, seen = rows
    _, looked = found(spark, users, items, seen, 5, block_items=16)
    share = sum(row["blocks"] for row in looked) / sum(row["n_blocks"] for row in looked)
    assert share < 0.5


def test_ties_and_odd_vectors(spark):
    users = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("inf"), 1.0]), (5, [-1.0, 0.0])]
    items = [(n, [2.0, float(n % 2)]) for n in range(20)] + [(50, None), (51, [0.0, 0.0]), (52, [float("nan"), 0.0])]
    best, _ = found(spark, users, items, {(1, 0), (1, 1)}, 4, block_items=8)
    assert best == {(1, n, 2.0, rank) for rank, n in enumerate((2, 3, 4, 5), 1)} | {
        (5, n, -2.0, rank) for rank, n in enumerate((0, 1, 2, 3), 1)
    }
    assert found(spark, users, items, {(1, n) for n in range(20)}, 4)[0] == {(5, n, -2.0, n + 1) for n in range(4)}
    assert found(spark, [], items, set(), 4)[0] == set()
    assert found(spark, users, [], set(), 4)[0] == set()


def test_unseen_items_of_a_factorisation(spark, ratings):
    """The same as predicting every pair that was not rated."""
    best, _ = factorize.unseen(ratings, 5)
    rows, numbers = factorize._numbered(ratings)
    model = factorize.fit(rows)
    users, items = numbers["user_id"], numbers["item_id"]
    rated = rows.select("user_id", "item_id")
    everything = users.join(items, F.lit(True)).join(rated, ["user_id", "item_id"], "left_anti")
    want = {(r["user_id"], r["item_id"]): r["prediction"] for r in model.transform(everything).collect()}
    got = {(r["user_id"], r["item_id"]): r["score"] for r in best.collect()}
    assert got.keys() == want.keys() and len(got) == 2
    for pair, score in want.items():
        assert got[pair] == pytest.approx(score, abs=1e-5)


def test_rounds_do_not_grow_with_small_blocks(spark, rows, monkeypatch):
    """Users are written once for so many items, whatever the size of a block."""
    users, items, seen = rows
    level = [(n, [float(x > 0) * 2 - 1 for x in v]) for n, v in items]  # all of one length
    rounds, stored = [], products.stored
    monkeypatch.setattr(products, "stored", lambda r, name: rounds.append(name) or stored(r, name))
    best, looked = found(spark, users, level, seen, 10, block_items=8)
    assert best == plain(users, level, seen, 10)
    assert rounds.count("round") == 1
    assert {row["n_blocks"] for row in looked} == {88}
    monkeypatch.setattr(products, "ROUND_ITEMS", 200)
    monkeypatch.setattr(products, "STEP_ITEMS", 24)
    best, looked = found(spark, users, items, seen, 10, block_items=8)
    assert best == plain(users, items, seen, 10)
    assert sum(row["blocks"] for row in looked) < sum(row["n_blocks"] for row in looked)
