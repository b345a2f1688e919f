"""Recommendations for all users at once from their histories and item similarities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators import filters, ranking, skew
from kindred.operators.cooccurrence import BY_CHANNEL

# Users of a channel that one part holds. The similarities of an item are sent to a part once for
# all its users.
USERS_PER_PART = 500
# Items of one user beyond which the user's candidates are cut into slices.
ITEMS_PER_SLICE = 1_000
# Parts a task sends the similarities of one item to.
PARTS_PER_TASK = 2_000
# Where the sums of a user and candidate are made.
PLACE = ("part", "slices", "slice")


def history_items(history: DataFrame, by: Sequence[str] = BY_CHANNEL) -> DataFrame:
    """Distinct items of each user with the latest rating, NULL where there is none.

    ``history`` has one row per (user, second, item). Every action counts here, whatever
    actions the similarities were computed from.
    """
    is_rating = (F.col("action") == filters.RATING_ACTION) & F.col("rating").isNotNull()
    rating = F.max_by("rating", F.when(is_rating, F.col("time")))
    return history.groupBy(*by, "user_id", "item_id").agg(rating.alias("rating"))


def contributions(
    items: DataFrame,
    similarities: DataFrame,
    by: Sequence[str] = BY_CHANNEL,
    users_per_part: int = USERS_PER_PART,
    items_per_slice: int = ITEMS_PER_SLICE,
) -> DataFrame:
    """Every history item of every user with the similarities of that item, and its ``PLACE``.

    There are far more of these rows than of anything else here, so they stay where they are made:
    users are cut into parts, each item of a part gets its similarities once, and the rows lie
    partitioned by place, so that sums per place, user and candidate need no shuffle. The
    candidates of a user with many items are cut into slices, all of which get the user's items.
    """
    person, item = [*by, "user_id"], [*by, "item_id"]
    large = skew.hot_keys(items.select(*person).distinct(), by, users_per_part)
    eager = skew.hot_keys(items, person, items_per_slice)
    sliced = skew.with_parts(items, eager, person).withColumnRenamed("parts", "slices")
    placed = skew.with_parts(sliced, large, by, spread_by="user_id").withColumn(
        "part", skew.part_of("user_id")
    )
    needed = placed.select(*item, "part", "slices").distinct()
    sent = skew.salted_join(needed, similarities, item, spread_by="part", limit=PARTS_PER_TASK)
    users = placed.select(
        *item,
        "part",
        "slices",
        F.explode(skew.all_parts("slices")).alias("slice"),
        F.struct("user_id", "rating").alias("user"),
    )
    similar = sent.select(
        *item,
        "part",
        "slices",
        skew.part_of("other_id", "slices").alias("slice"),
        F.struct("other_id", "score").alias("similar"),
    )
    met = (
        skew.spread(users.unionByName(similar, allowMissingColumns=True), [*by, *PLACE])
        .groupBy(*item, *PLACE)
        .agg(F.collect_list("user").alias("users"), F.collect_list("similar").alias("similar"))
    )
    return met.select(*item, *PLACE, F.inline("users"), "similar").select(
        *item, *PLACE, "user_id", "rating", F.inline("similar")
    )


def candidate_scores(contributions: DataFrame, by: Sequence[str] = BY_CHANNEL) -> DataFrame:
    """Weighted scores of all candidates of all users.

    A rated history item adds ``score * rating`` to the numerator and ``score`` to the
    denominator. An unrated one adds ``score`` to the numerator only, and 1 to the
    denominator if it is the user's first (smallest) history item leading to the candidate.
    A zero denominator gives NULL.
    """
    rated = F.col("rating").isNotNull()
    sums = contributions.groupBy(*by, "user_id", "other_id").agg(
        F.sum(F.col("score") * F.coalesce("rating", F.lit(1.0))).alias("numerator"),
        F.sum(F.when(rated, F.col("score")).otherwise(0)).alias("rated_weight"),
        F.min_by(~rated, "item_id").alias("first_unrated"),
    )
    denominator = F.col("rated_weight") + F.when(F.col("first_unrated"), 1).otherwise(0)
    return sums.select(
        *by,
        "user_id",
        F.col("other_id").alias("item_id"),
        F.try_divide("numerator", denominator).alias("score"),
    )


def recommendations(
    history: DataFrame,
    similarities: DataFrame,
    num: int | None = ranking.RECOMMENDATIONS_DEFAULT,
    exclude_seen: bool = False,
    by: Sequence[str] = BY_CHANNEL,
) -> DataFrame:
    """The best ``num`` items of every user. Seen items stay in unless excluded."""
    items = history_items(history, by)
    scored = candidate_scores(contributions(items, similarities, by), [*by, *PLACE])
    if exclude_seen:
        scored = scored.join(items, [*by, "user_id", "item_id"], "left_anti")
    order = [F.col("score").desc_nulls_last(), F.col("item_id")]
    size = ranking.result_size(num, ranking.RECOMMENDATIONS_DEFAULT)
    return ranking.top_k(scored.drop(*PLACE), [*by, "user_id"], order, size)


def recommendations_for(
    history: DataFrame,
    similarities: DataFrame,
    num: int | None = ranking.RECOMMENDATIONS_DEFAULT,
) -> DataFrame:
    """The best items of a single user, whose history is all ``history`` holds.

    Nothing is read before the request itself runs: the smallest and largest of the user's items go
    to the scan of the similarities, which lie sorted by item, as subqueries, and the join is
    decided on the measured size of the items.
    """
    items = history_items(history, by=())
    ends = items.agg(F.min("item_id").alias("low"), F.max("item_id").alias("high"))
    inside = F.col("item_id").between(ends.select("low").scalar(), ends.select("high").scalar())
    joined = similarities.where(inside).join(skew.measured(items, ["item_id"]), "item_id")
    return (
        candidate_scores(joined, by=())
        .orderBy(F.col("score").desc_nulls_last(), "item_id")
        .limit(ranking.result_size(num, ranking.RECOMMENDATIONS_DEFAULT))
    )
