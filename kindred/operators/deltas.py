"""Pair counts and sums kept up to date: what new rows add to those of the rows before.

Counts of pairs only grow by pairs with at least one new row, so a batch needs its own rows, and of the
rows before only those of its users: new rows are paired with each other and with old ones, and
pairs of two old rows are never made again. What comes out is added to the stored counts and sums;
scores are read off these.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators import cooccurrence, skew

# Sums over the co-ratings of a pair, from the ratings of its smaller and its larger item.
PRODUCTS = {
    "sum_x": lambda x, y: x,
    "sum_y": lambda x, y: y,
    "sum_xx": lambda x, y: x * x,
    "sum_yy": lambda x, y: y * y,
    "sum_xy": lambda x, y: x * y,
}
ADDED = ("n", *PRODUCTS)


def fresh_rows(rows: DataFrame, seen: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct (user, item, rating) that were not there before."""
    key = [*by, "user_id", "item_id", "rating"]
    known = seen.select(*key).toDF(*[f"known_{name}" for name in key])
    same = [F.col(name).eqNullSafe(F.col(f"known_{name}")) for name in key]
    return rows.select(*key).distinct().join(known, same, "left_anti")


def _cross_pairs(fresh: DataFrame, old: DataFrame, by: Sequence[str], limit: int) -> DataFrame:
    """Pairs of a new and an old row of a user, the smaller item first."""
    key = [*by, "user_id"]
    new = fresh.select(*key, F.col("item_id").alias("new_id"), F.col("rating").alias("new_rating"))
    # A user's old rows may be many; they are spread, and the new ones go to each part.
    met = skew.salted_join(old, new, key, spread_by="item_id", limit=limit)
    first = F.col("item_id") < F.col("new_id")

    def ordered(one: str, other: str) -> list[Column]:
        return [F.when(first, F.col(one)).otherwise(F.col(other)), F.when(first, F.col(other)).otherwise(F.col(one))]

    item, partner = ordered("item_id", "new_id")
    rating, other_rating = ordered("rating", "new_rating")
    return met.where(F.col("item_id") != F.col("new_id")).select(
        *key,
        item.alias("item_id"),
        rating.alias("rating"),
        partner.alias("other_id"),
        other_rating.alias("other_rating"),
    )


def added_pairs(
    fresh: DataFrame,
    seen: DataFrame,
    by: Sequence[str] = (),
    block_items: int = cooccurrence.BLOCK_ITEMS,
) -> DataFrame:
    """What new rows add to each pair: users ``n``, and sums where rows have ratings."""
    users = skew.measured(fresh.select(*by, "user_id").distinct(), [*by, "user_id"])
    old = seen.join(users, [*by, "user_id"], "left_semi").select(*by, "user_id", "item_id", "rating")
    inside = cooccurrence.same_user_pairs(fresh, by, carry=["rating"], block_items=block_items)
    pairs = inside.unionByName(_cross_pairs(fresh, old, by, block_items))
    x, y = F.col("rating"), F.col("other_rating")
    sums = [F.sum(product(x, y)).alias(name) for name, product in PRODUCTS.items()]
    return pairs.groupBy(*by, "item_id", "other_id").agg(F.count(F.lit(1)).alias("n"), *sums)


def added_items(fresh: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What new rows add to the users of each item."""
    return cooccurrence.item_counts(fresh, by)


def summed(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows of several batches added up."""
    return rows.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in values])


def pair_table(pairs: DataFrame, items: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``n12, n1, n2`` and ``total`` of each pair, from summed pairs and items."""
    counts = skew.measured(cooccurrence.with_total(items, by), [*by, "item_id"])
    first = counts.withColumnRenamed("users", "n1")
    second = counts.select(*by, F.col("item_id").alias("other_id"), F.col("users").alias("n2"))
    return (
        pairs.withColumnRenamed("n", "n12")
        .join(first, [*by, "item_id"])
        .join(second, [*by, "other_id"])
        .select(*by, "item_id", "other_id", "n12", "n1", "n2", "total")
    )
