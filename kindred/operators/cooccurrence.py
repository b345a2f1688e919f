"""Item pairs seen with the same user, counted or summed per pair.

Rows: distinct (user, item) or (user, item, rating). A user with k items gives k(k-1)/2
pairs; those pairs are the result being asked for, so the work is theirs, but it is never put
into one task: the items of a user with many of them are cut into blocks, and each pair of
blocks (a tile) is joined on its own. Pairs go straight from the join into a partial
aggregate, so the shuffle carries one row per pair and task.

``by`` names the columns that keep channels apart; pass ``()`` for rows of one channel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators import skew

BY_CHANNEL = ("channel_id",)
# Items of one user that a task pairs with each other (at most about twice this many).
BLOCK_ITEMS = 1_000


def user_items(interactions: DataFrame, by: Sequence[str] = BY_CHANNEL) -> DataFrame:
    """Distinct (user, item)."""
    return (
        interactions.where(F.col("user_id").isNotNull() & F.col("item_id").isNotNull())
        .select(*by, "user_id", "item_id")
        .distinct()
    )


def user_item_ratings(interactions: DataFrame, by: Sequence[str] = BY_CHANNEL) -> DataFrame:
    """Distinct (user, item, rating): an item rated twice differently counts twice."""
    return (
        interactions.where(
            F.col("user_id").isNotNull()
            & F.col("item_id").isNotNull()
            & F.col("rating").isNotNull()
        )
        .select(*by, "user_id", "item_id", "rating")
        .distinct()
    )


def item_counts(pairs: DataFrame, by: Sequence[str] = BY_CHANNEL) -> DataFrame:
    """Users per item."""
    return pairs.groupBy(*by, "item_id").agg(F.count(F.lit(1)).alias("users"))


def with_total(counts: DataFrame, by: Sequence[str] = BY_CHANNEL) -> DataFrame:
    """Add ``total``, the number of distinct (user, item) rows, to item counts."""
    if not by:
        return counts.withColumn("total", counts.agg(F.sum("users").alias("total")).scalar())
    totals = counts.groupBy(*by).agg(F.sum("users").alias("total"))
    return counts.join(totals, list(by))


def _tiles(rows: DataFrame, group: Sequence[str], block_items: int) -> DataFrame:
    """Place rows in tiles (low, high): a user with one block has the single tile (0, 0)."""
    hot = skew.hot_keys(rows, group, block_items)
    blocks = skew.with_parts(rows, hot, group).withColumn("block", skew.part_of("item_id"))
    placed = blocks.withColumn("opposite", F.explode(skew.all_parts()))
    return placed.withColumns(
        {"low": F.least("block", "opposite"), "high": F.greatest("block", "opposite")}
    ).drop("opposite", "parts")


def same_user_pairs(
    rows: DataFrame,
    by: Sequence[str] = BY_CHANNEL,
    carry: Sequence[str] = (),
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """One row per user and pair ``item_id < other_id``; ``carry`` columns come from both sides."""
    group = [*by, "user_id"]
    tiles = skew.spread(_tiles(rows, group, block_items), [*group, "low", "high"])
    # Both sides are the same plan, so its shuffle is written once and read twice.
    left, right = tiles.alias("left"), tiles.alias("right")
    same_tile = [
        F.col(f"left.{name}") == F.col(f"right.{name}") for name in (*group, "low", "high")
    ]
    one_block = F.col("left.low") == F.col("left.high")
    # Off the diagonal only pairs across the two blocks count, so each pair comes out once.
    once = one_block | (F.col("left.block") != F.col("right.block"))
    ordered = F.col("left.item_id") < F.col("right.item_id")
    return left.join(right, [*same_tile, ordered, once]).select(
        *[F.col(f"left.{name}") for name in (*group, "item_id", *carry)],
        F.col("right.item_id").alias("other_id"),
        *[F.col(f"right.{name}").alias(f"other_{name}") for name in carry],
    )


def pair_counts(
    pairs: DataFrame, by: Sequence[str] = BY_CHANNEL, block_items: int = BLOCK_ITEMS
) -> DataFrame:
    """Users per item pair (``n12``)."""
    return (
        same_user_pairs(pairs, by, block_items=block_items)
        .groupBy(*by, "item_id", "other_id")
        .agg(F.count(F.lit(1)).alias("n12"))
    )


def pair_table(
    interactions: DataFrame,
    by: Sequence[str] = BY_CHANNEL,
    total: bool = True,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """``n12, n1, n2`` per item pair, and ``total`` where a score needs it.

    The item counts join the rows of users and items before these are paired, and each pair
    carries its two counts: the pairs, by far the largest table, are shuffled once, when they
    are counted.
    """
    pairs = user_items(interactions, by)
    counts = item_counts(pairs, by)
    if total:
        counts = with_total(counts, by)
    carry = ["users", "total"] if total else ["users"]
    known = pairs.join(skew.measured(counts, [*by, "item_id"]), [*by, "item_id"])
    same = [F.max("total").alias("total")] if total else []
    return (
        same_user_pairs(known, by, carry=carry, block_items=block_items)
        .groupBy(*by, "item_id", "other_id")
        .agg(
            F.count(F.lit(1)).alias("n12"),
            F.max("users").alias("n1"),
            F.max("other_users").alias("n2"),
            *same,
        )
    )


def co_ratings(
    interactions: DataFrame, by: Sequence[str] = BY_CHANNEL, block_items: int = BLOCK_ITEMS
) -> DataFrame:
    """Sums over the co-ratings of each item pair: enough for a correlation, and mergeable."""
    x, y = F.col("rating"), F.col("other_rating")
    ratings = user_item_ratings(interactions, by)
    return (
        same_user_pairs(ratings, by, carry=["rating"], block_items=block_items)
        .groupBy(*by, "item_id", "other_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(x).alias("sum_x"),
            F.sum(y).alias("sum_y"),
            F.sum(x * x).alias("sum_xx"),
            F.sum(y * y).alias("sum_yy"),
            F.sum(x * y).alias("sum_xy"),
        )
    )
