"""Top-k per group. Ties go to the smaller item id.

``row_number() <= k`` lets Spark keep only k rows per group before the shuffle, so a large
group reaches its final task already cut down, without losing any result row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.cooccurrence import BY_CHANNEL

# How many results a request without a positive number gets.
SIMILAR_ITEMS_DEFAULT = 10
RECOMMENDATIONS_DEFAULT = 20
COMPARISON_SIZE = 20


def top_k(
    rows: DataFrame, group: Sequence[str], order: Sequence[Column], k: int
) -> DataFrame:
    """The first ``k`` rows per group, numbered in ``rank``."""
    window = Window.partitionBy(*group).orderBy(*order)
    ranked = rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


def result_size(num: int | None, default: int) -> int:
    """Zero or less means the default; no number at all means no results."""
    if num is None:
        return 0
    return num if num > 0 else default


def similar_items(
    similarities: DataFrame,
    num: int | None = SIMILAR_ITEMS_DEFAULT,
    by: Sequence[str] = BY_CHANNEL,
) -> DataFrame:
    """The best ``num`` other items of every item, from symmetric similarities."""
    size = result_size(num, SIMILAR_ITEMS_DEFAULT)
    order = [F.col("score").desc(), F.col("other_id")]
    return top_k(similarities, [*by, "item_id"], order, size)


def similar_to(similarities: DataFrame, item: int, num: int | None) -> DataFrame:
    """One item's list: a filtered scan and a bounded sort."""
    return (
        similarities.where(F.col("item_id") == item)
        .orderBy(F.col("score").desc(), "other_id")
        .limit(result_size(num, SIMILAR_ITEMS_DEFAULT))
    )


def compare_algorithms(
    similarities: DataFrame, size: int = COMPARISON_SIZE, by: Sequence[str] = BY_CHANNEL
) -> DataFrame:
    """Similar items side by side for all algorithms in the table."""
    order = [F.col("score").desc(), F.col("other_id")]
    return top_k(similarities, [*by, "algo_id", "item_id"], order, size)


def stored_recommendations(
    predictions: DataFrame,
    num: int | None = RECOMMENDATIONS_DEFAULT,
    by: Sequence[str] = BY_CHANNEL,
) -> DataFrame:
    """The best ``num`` stored predictions of every user."""
    size = result_size(num, RECOMMENDATIONS_DEFAULT)
    order = [F.col("score").desc(), F.col("item_id")]
    return top_k(predictions, [*by, "user_id"], order, size)
