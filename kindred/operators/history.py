"""User history: one row per (channel, user, second, item), last write wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import keys, text, times
from kindred.operators import filters

HISTORY_KEY = ("channel_id", "user_id", "time", "item_id")


def latest(history: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """The winning row per key: highest ``ingest_seq``, then action and rating.

    An aggregate rather than a window, so replayed rows merge before the shuffle. ``also`` names
    columns whose values are kept apart.
    """
    winner = F.max(F.struct("ingest_seq", "action", "rating")).alias("winner")
    return (
        history.groupBy(*HISTORY_KEY, *also)
        .agg(winner)
        .select(*HISTORY_KEY, "winner.action", "winner.rating", "winner.ingest_seq", *also)
    )


def from_interactions(interactions: DataFrame, ingest_seq: Column) -> DataFrame:
    """History rows of newly ingested interactions, at one-second grain."""
    return interactions.select(
        "channel_id",
        "user_id",
        F.date_trunc("second", "time").alias("time"),
        "item_id",
        "action",
        "rating",
        ingest_seq.cast("bigint").alias("ingest_seq"),
    )


def _is_rating() -> Column:
    return (F.col("action") == filters.RATING_ACTION) & F.col("rating").isNotNull()


def cell_value() -> Column:
    """``action`` or ``action:rating``."""
    return F.concat_ws(":", "action", text.plain_number(F.col("rating")))


def responses(history: DataFrame) -> DataFrame:
    """History as shown to callers.

    Rating rows show their rating and no action; other rows show their action, with a rating
    they may carry kept in its text.
    """
    return history.select(
        "channel_id",
        "user_id",
        "item_id",
        F.when(_is_rating(), F.col("rating")).alias("rating"),
        F.when(~_is_rating(), cell_value()).alias("action"),
        times.seconds_text("time").alias("time"),
    )


def user_history(history: DataFrame, channel: str, user: int) -> DataFrame:
    """One user's history, newest first as ``rank`` numbers it, from a filtered scan."""
    mine = (F.col("channel_id") == channel) & (F.col("user_id") == user)
    shown = responses(latest(history.where(mine)))
    newest = Window.partitionBy("channel_id", "user_id").orderBy(F.col("time").desc(), "item_id")
    return shown.withColumn("rank", F.row_number().over(newest).cast("bigint")).orderBy("rank")


def to_cells(history: DataFrame) -> DataFrame:
    """Key-value cells: ``channel:user`` with ``epoch:item`` and ``action[:rating]``."""
    return history.select(
        keys.history_key("channel_id", "user_id").alias("rowkey"),
        F.lit("i").alias("family"),
        keys.joined(times.epoch_seconds("time"), "item_id").alias("qualifier"),
        cell_value().alias("value"),
    )


def from_cells(cells: DataFrame) -> DataFrame:
    """History rows back from cells."""
    # Only a rating carries its number; any other action may hold colons of its own.
    number = text.number(F.regexp_extract("value", f"^{filters.RATING_ACTION}:(.*)$", 1))
    action = F.when(number.isNotNull(), filters.RATING_ACTION).otherwise(F.col("value"))
    return cells.where(F.col("family") == "i").select(
        keys.part("rowkey", 0).alias("channel_id"),
        keys.part("rowkey", 1).cast("bigint").alias("user_id"),
        F.timestamp_seconds(keys.part("qualifier", 0).cast("bigint")).alias("time"),
        keys.part("qualifier", 1).cast("bigint").alias("item_id"),
        action.alias("action"),
        number.alias("rating"),
    )
