"""Interaction filters. All compare a column with a literal, so they reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names that other tables and callers use.
RATING_ACTION = "rating"
INGESTION_TYPES = ("bulk", "stream")
RATING_ALGORITHMS = ("pearson", "als", "alsimplicit")


def of_channel(rows: DataFrame, channel: str) -> DataFrame:
    return rows.where(F.col("channel_id") == channel)


def of_actions(rows: DataFrame, actions: Sequence[str] | None) -> DataFrame:
    """Rows with one of the actions; no list or an empty one keeps all."""
    return rows.where(F.col("action").isin(list(actions))) if actions else rows


def ratings_only(rows: DataFrame) -> DataFrame:
    """Rating rows that carry a rating (streamed rating rows may not)."""
    return rows.where((F.col("action") == RATING_ACTION) & F.col("rating").isNotNull())


def of_ingestion(rows: DataFrame, kind: str | None) -> DataFrame:
    """Rows of one ingestion type; any other value filters nothing."""
    return rows.where(F.col("ingestion") == kind) if kind in INGESTION_TYPES else rows


def of_upload(rows: DataFrame, upload_id: str) -> DataFrame:
    return rows.where(F.col("bulkfile") == upload_id)


def of_item(rows: DataFrame, channel: str, item: int) -> DataFrame:
    return rows.where((F.col("channel_id") == channel) & (F.col("item_id") == item))


def for_algorithm(rows: DataFrame, base: str, actions: Sequence[str] | None) -> DataFrame:
    """The input rows of an algorithm: its action list, and ratings where it needs them."""
    if base in RATING_ALGORITHMS:
        rows = ratings_only(rows)
    return of_actions(rows, actions)
