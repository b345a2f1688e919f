from __future__ import annotations

import math
import random
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from conftest import scores
from kindred.functions import scores as formulas
from kindred.operators import cooccurrence, ranking, similarity

EXPECTED = {
    "cooccurrence": {(10, 20): 2, (10, 30): 1, (20, 30): 2},
    "jaccard": {(10, 20): 500, (10, 30): 250, (20, 30): 667},
    "cosine": {(10, 20): 577, (10, 30): 318, (20, 30): 636},
    "loglikelihood": {(10, 20): 3398, (10, 30): 715, (20, 30): 6612},
}


@pytest.mark.parametrize("by", [("channel_id",), ()])
@pytest.mark.parametrize("base", EXPECTED)
def test_hand_worked_scores(baskets, base, by):
    assert scores(similarity.similarity(baskets, base, by=by)) == EXPECTED[base]


def test_all_scores_from_one_pair_table(baskets):
    wide = similarity.count_similarities(baskets)
    for base, expected in EXPECTED.items():
        assert scores(wide, base) == expected


def test_hand_worked_pearson(ratings):
    expected = {(10, 20): 107, (10, 30): 0, (20, 30): 985}
    assert scores(similarity.similarity(ratings, "pearson")) == expected


def test_pearson_counts_each_distinct_rating(spark):
    rows = [(1, 10, 1.0), (1, 10, 5.0), (1, 20, 2.0), (2, 10, 3.0), (2, 20, 4.0)]
    frame = spark.createDataFrame(
        [("CH-1", u, i, "rating", r) for u, i, r in rows],
        "channel_id string, user_id bigint, item_id bigint, action string, rating double",
    )
    sums = cooccurrence.co_ratings(frame).collect()
    assert [(r["n"], r["sum_x"], r["sum_y"], r["sum_xy"]) for r in sums] == [(3, 9, 8, 24)]


def test_unknown_base_is_refused(baskets):
    with pytest.raises(ValueError, match="not an item similarity"):
        similarity.similarity(baskets, "als")


def test_action_filter(baskets):
    assert similarity.similarity(baskets, "jaccard", ["buy"]).count() == 0
    assert similarity.similarity(baskets, "jaccard", []).count() == 3


@pytest.fixture(scope="module")
def skewed(spark):
    """Random baskets in two channels; one user of each has nearly all the items."""
    random.seed(3)
    rows = [
        (f"CH-{u % 2}", u, item, random.randint(1, 5))
        for u in range(30)
        for item in random.sample(range(60), 55 if u < 2 else random.randint(0, 9))
    ]
    frame = spark.createDataFrame(
        [(c, u, i, "rating", float(r)) for c, u, i, r in rows],
        "channel_id string, user_id bigint, item_id bigint, action string, rating double",
    )
    return rows, frame


@pytest.mark.parametrize("block_items", [1, 2, 7, 1000])
def test_blocks_give_every_pair_once(skewed, block_items):
    rows, frame = skewed
    owned = defaultdict(set)
    for channel, user, item, _ in rows:
        owned[channel, user].add(item)
    expected = defaultdict(int)
    for (channel, _), items in owned.items():
        for first, second in combinations(sorted(items), 2):
            expected[channel, first, second] += 1
    pairs = cooccurrence.pair_counts(
        cooccurrence.user_items(frame), block_items=block_items
    ).collect()
    assert len(pairs) == len(expected)
    assert {(p["channel_id"], p["item_id"], p["other_id"]): p["n12"] for p in pairs} == expected


def test_blocks_keep_rating_sums(skewed):
    _, frame = skewed
    whole = cooccurrence.co_ratings(frame)
    cut = cooccurrence.co_ratings(frame, block_items=3)
    assert whole.exceptAll(cut).isEmpty() and cut.exceptAll(whole).isEmpty()


def test_properties(skewed):
    _, frame = skewed
    table = similarity.count_similarities(frame)
    joined = table.join(
        cooccurrence.pair_table(frame), ["channel_id", "item_id", "other_id"]
    ).collect()
    for row in joined:
        assert row["item_id"] < row["other_id"]
        assert 0 < row["n12"] <= min(row["n1"], row["n2"])
        assert 0 <= row["jaccard"] <= 1000
        assert row["loglikelihood"] >= 0
    for row in similarity.similarity(frame, "pearson").collect():
        assert 0 <= row["score"] <= 1000
    doubled = similarity.count_similarities(frame.unionAll(frame))
    assert table.exceptAll(doubled).isEmpty() and doubled.exceptAll(table).isEmpty()
    one_way = similarity.similarity(frame.drop("channel_id"), "cosine", by=())
    both = scores(similarity.symmetric(one_way))
    assert all(both[b, a] == score for (a, b), score in both.items())


def test_formulas_against_plain_arithmetic(spark):
    rows = [(n12, n1, n2, total) for n12 in (1, 2, 9) for n1 in (9, 40) for n2 in (9, 77)
            for total in (200, 5000)]
    frame = spark.createDataFrame(rows, "n12 bigint, n1 bigint, n2 bigint, total bigint")
    columns = [F.col(c) for c in frame.columns]
    result = frame.select(
        *columns,
        formulas.jaccard(*columns).alias("jaccard"),
        formulas.cosine(*columns).alias("cosine"),
        formulas.loglikelihood(*columns).alias("llr"),
    ).collect()

    def h(*xs):
        def xlx(x):
            return x * math.log(x) if x else 0.0

        return xlx(sum(xs)) - sum(map(xlx, xs))

    def away(x):
        return math.floor(x + 0.5)

    for r in result:
        a, b, c, n = r["n12"], r["n1"], r["n2"], r["total"]
        llr = 2 * (h(c, b - a + n) + h(b, c - a + n) - h(a, c - a, b - a, n))
        assert r["jaccard"] == away(1000 * a / (b + c - a))
        assert r["cosine"] == away(1000 * a / (math.sqrt(b) + math.sqrt(c)))
        assert r["llr"] == max(0, away(1000 * llr))


def test_top_k_breaks_ties_by_item(spark):
    frame = spark.createDataFrame(
        [("CH-1", 1, other, 5) for other in (4, 2, 3)] + [("CH-1", 1, 9, 7)],
        "channel_id string, item_id bigint, other_id bigint, score bigint",
    )
    best = ranking.similar_items(frame, 3).orderBy("rank").collect()
    assert [r["other_id"] for r in best] == [9, 2, 3]
    assert ranking.similar_items(frame, 0).count() == 4
    assert ranking.similar_items(frame, None).count() == 0
    assert [r["other_id"] for r in ranking.similar_to(frame, 1, 2).collect()] == [9, 2]
