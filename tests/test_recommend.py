from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kindred.operators import recommend, similarity, skew

ITEMS = "channel_id string, user_id bigint, item_id bigint, rating double"


def candidates(spark, baskets, known, **options):
    similarities = similarity.symmetric(similarity.similarity(baskets, "jaccard"))
    frame = spark.createDataFrame([("CH-1", 9, i, r) for i, r in known], ITEMS)
    joined = recommend.contributions(frame, similarities, **options)
    scored = recommend.candidate_scores(joined).collect()
    return {r["item_id"]: r["score"] for r in scored}


@pytest.mark.parametrize(
    ("known", "expected"),
    [
        ([(10, None), (20, None)], {10: 500, 20: 500, 30: 917}),
        ([(10, 5.0), (20, 3.0)], {10: 3, 20: 5, 30: 3.5452562704}),
        ([(10, None), (20, 3.0)], {10: 3, 20: 500, 30: 3.3697604790}),
        ([(10, 5.0), (20, None)], {10: 500, 20: 5, 30: 7.668}),
    ],
)
def test_hand_worked_scores(spark, baskets, known, expected):
    assert candidates(spark, baskets, known) == pytest.approx(expected)


def accumulate(known, similar):
    """Scores of one user by walking the history in item order."""
    sums = {}
    for item, rating in sorted(known.items()):
        for other, score in similar.get(item, []):
            weight = 0 if rating is None else score
            value = score if rating is None else score * rating
            if other in sums:
                sums[other] = (sums[other][0] + value, sums[other][1] + weight)
            else:
                sums[other] = (value, 1 if rating is None else weight)
    return {o: (n / d if d else None) for o, (n, d) in sums.items()}


@pytest.mark.parametrize("users_per_part", [1, 4, 1000])
def test_matches_accumulating_item_by_item(spark, users_per_part):
    random.seed(11)
    similar = {
        i: [
            (o, random.choice([0, 3, 250, 900]))
            for o in range(12)
            if o != i and random.random() < 0.6
        ]
        for i in range(12)
    }
    users = {
        u: {i: random.choice([None, 1.0, 4.0]) for i in range(12) if random.random() < 0.5}
        for u in range(15)
    }
    items = spark.createDataFrame(
        [("CH-1", u, i, r) for u, known in users.items() for i, r in known.items()], ITEMS
    )
    similarities = spark.createDataFrame(
        [("CH-1", i, o, s) for i, others in similar.items() for o, s in others],
        "channel_id string, item_id bigint, other_id bigint, score bigint",
    )
    joined = recommend.contributions(items, similarities, users_per_part=users_per_part)
    rows = recommend.candidate_scores(joined).collect()
    expected = {
        (u, o): score
        for u, known in users.items()
        for o, score in accumulate(known, similar).items()
    }
    assert {(r["user_id"], r["item_id"]): r["score"] for r in rows} == expected


def test_latest_rating_counts_and_any_action_is_history(spark):
    frame = spark.createDataFrame(
        [
            ("CH-1", 1, "2024-01-01 00:00:01", 10, "rating", 2.0),
            ("CH-1", 1, "2024-01-01 00:00:05", 10, "rating", 4.0),
            ("CH-1", 1, "2024-01-01 00:00:09", 10, "view", None),
            ("CH-1", 1, "2024-01-01 00:00:02", 20, "view", None),
            ("CH-1", 1, "2024-01-01 00:00:02", 30, "buy", 7.0),
        ],
        "channel_id string, user_id bigint, time string, item_id bigint, action string, "
        "rating double",
    ).withColumn("time", F.to_timestamp("time"))
    rows = recommend.history_items(frame).collect()
    assert {r["item_id"]: r["rating"] for r in rows} == {10: 4.0, 20: None, 30: None}


def test_recommendations_may_leave_out_seen_items(spark, baskets):
    similarities = similarity.symmetric(similarity.similarity(baskets, "jaccard"))
    history = baskets.select(
        "*", F.current_timestamp().alias("time"), F.lit(None).cast("double").alias("rating")
    )
    seen = {(r["user_id"], r["item_id"]) for r in baskets.collect()}
    every = recommend.recommendations(history, similarities).collect()
    unseen = recommend.recommendations(history, similarities, exclude_seen=True).collect()
    assert any((r["user_id"], r["item_id"]) in seen for r in every)
    assert unseen and not any((r["user_id"], r["item_id"]) in seen for r in unseen)


@pytest.mark.parametrize("limit", [1, 3, 100])
def test_salted_join_equals_plain_join(spark, limit):
    large = spark.range(200).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("key"), "id"
    )
    other = spark.range(7).select(F.col("id").alias("key"), (F.col("id") * 10).alias("value"))
    salted = skew.salted_join(large, other, ["key"], "id", limit).select("key", "id", "value")
    plain = large.join(other, "key").select("key", "id", "value")
    assert salted.exceptAll(plain).isEmpty() and plain.exceptAll(salted).isEmpty()


def history_and_similarities(spark, channels):
    """Twenty users a channel with some of twelve items; user 0 has all of them."""
    random.seed(5)
    known = [
        (f"CH-{c}", u, i, random.choice([None, 2.0]))
        for c in range(channels)
        for u in range(20)
        for i in range(12)
        if u == 0 or random.random() < 0.4
    ]
    similar = [
        (f"CH-{c}", i, o, random.choice([3, 250, 900]))
        for c in range(channels)
        for i in range(12)
        for o in range(15)
        if o != i and random.random() < 0.6
    ]
    return spark.createDataFrame(known, ITEMS), spark.createDataFrame(
        similar, "channel_id string, item_id bigint, other_id bigint, score bigint"
    )


@pytest.mark.parametrize("by", [("channel_id",), ()])
@pytest.mark.parametrize(("users_per_part", "items_per_slice"), [(3, 100), (100, 5), (3, 5)])
def test_parts_and_slices_lose_and_repeat_nothing(spark, by, users_per_part, items_per_slice):
    known, similar = history_and_similarities(spark, 2 if by else 1)
    columns = [*by, "user_id", "item_id", "rating", "other_id", "score"]
    plain = known.join(similar, [*by, "item_id"]).select(columns)
    known, similar = known.select(columns[:-2]), similar.select(*by, "item_id", "other_id", "score")
    made = recommend.contributions(known, similar, by, users_per_part, items_per_slice)
    assert sorted(made.select(columns).collect(), key=repr) == sorted(plain.collect(), key=repr)
    places = made.groupBy(*by, "user_id", "other_id").agg(
        F.count_distinct("part", "slices", "slice").alias("places")
    )
    assert places.where("places > 1").isEmpty()
    used = made.groupBy(*by, "user_id").agg(F.count_distinct("slice").alias("slices"))
    assert used.where("user_id = 0 AND slices > 1").isEmpty() == (items_per_slice == 100)


def test_users_that_have_no_similar_item_get_nothing(spark):
    known = spark.createDataFrame([("CH-1", 1, 10, None), (None, 2, 10, None)], ITEMS)
    similar = spark.createDataFrame(
        [("CH-1", 20, 10, 5), ("CH-2", 10, 20, 5)],
        "channel_id string, item_id bigint, other_id bigint, score bigint",
    )
    assert recommend.contributions(known, similar).isEmpty()


@pytest.mark.parametrize("keys", [["key"], []])
def test_parts_are_the_same_when_the_join_is_spread(spark, keys):
    rows = spark.range(300).select(F.when(F.col("id") < 250, 1).otherwise(2).alias("key"), "id")
    hot = skew.hot_keys(rows, keys, 100)
    spread = skew.with_parts(rows, hot, keys, spread_by="id")
    assert spread.columns == ["key", "id", "parts"]
    found = {(r["key"], r["parts"]): r["count"] for r in spread.groupBy("key", "parts").count().collect()}
    assert found == ({(1, 3): 250, (2, 1): 50} if keys else {(1, 3): 250, (2, 3): 50})
