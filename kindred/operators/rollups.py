"""Counts and sketches kept per batch, from which dashboards are answered without interactions.

A rollup row counts the interactions of one channel, ingestion type, upload, action and UTC day, and
holds sketches of their distinct users and items. Counts add up and sketches unite, so rows of
several batches, of days or of actions merge in any order to those of any range; distinct counts are
within ``DISTINCT_ERROR`` (one standard deviation). A batch that is written again replaces its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import times
from kindred.operators import filters
from kindred.operators.cooccurrence import BY_CHANNEL

# The columns that are counted by, and the size of sketches: 2 to this many registers.
KEYS = ("channel_id", "ingestion", "bulkfile", "action", "day")
SKETCH_BITS = 14
# Standard deviation of a sketch of that size, in the worst case of united ones.
DISTINCT_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def rolled_up(rows: DataFrame) -> DataFrame:
    """Interactions as rollup rows."""
    dated = rows.withColumn("day", F.to_date("time"))
    return dated.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("hits"),
        F.min("time").alias("first"),
        F.max("time").alias("last"),
        F.hll_sketch_agg("user_id", F.lit(SKETCH_BITS)).alias("users"),
        F.hll_sketch_agg("item_id", F.lit(SKETCH_BITS)).alias("items"),
    )


def merged(rollups: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rollup rows summed and united by some of their columns, or by others added to them."""
    return rollups.groupBy(*keys).agg(
        F.sum("hits").alias("hits"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.hll_union_agg("users").alias("users"),
        F.hll_union_agg("items").alias("items"),
    )


def of_days(rollups: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows of the days from ``first`` to ``last``, both included."""
    if first is not None:
        rollups = rollups.where(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        rollups = rollups.where(F.col("day") <= F.lit(last).cast("date"))
    return rollups


def _hits() -> Column:
    return F.sum("hits").alias("hits")


def daily_counts(
    rollups: DataFrame, by: Sequence[str] = BY_CHANNEL, ingestion: str | None = None
) -> DataFrame:
    """Rows per UTC day, optionally of one ingestion type."""
    counts = filters.of_ingestion(rollups, ingestion).groupBy(*by, "day").agg(_hits())
    return counts.withColumn("day", times.day_text("day"))


def counts_by(rollups: DataFrame, field: str, by: Sequence[str] = BY_CHANNEL) -> DataFrame:
    """Rows per value of a field."""
    return rollups.where(F.col(field).isNotNull()).groupBy(*by, field).agg(_hits())


def totals(rollups: DataFrame, by: Sequence[str] = BY_CHANNEL) -> DataFrame:
    """Rows, and about how many distinct users and items."""
    return merged(rollups, by).select(
        *by,
        "hits",
        F.hll_sketch_estimate("users").alias("distinct_users"),
        F.hll_sketch_estimate("items").alias("distinct_items"),
    )


def facets(rollups: DataFrame) -> DataFrame:
    """All counts of the channel page: per day, ingestion type, action, and in total."""
    named = (
        F.when(F.grouping("day") == 0, "day")
        .when(F.grouping("ingestion") == 0, "ingestion")
        .when(F.grouping("action") == 0, "action")
        .otherwise("total")
    )
    streamed = F.when(F.col("ingestion") == "stream", F.col("hits")).otherwise(0)
    sets = [["channel_id", name] for name in ("day", "ingestion", "action")] + [["channel_id"]]
    return (
        rollups.withColumn("streamed", streamed)
        .groupingSets(sets, "channel_id", "day", "ingestion", "action")
        .agg(
            named.alias("facet"),
            F.coalesce(times.day_text("day"), "ingestion", "action").alias("value"),
            _hits(),
            F.sum("streamed").alias("stream_hits"),
        )
        .select("channel_id", "facet", "value", "hits", "stream_hits")
    )


def upload_daily_counts(rollups: DataFrame) -> DataFrame:
    """Rows per upload and day."""
    return daily_counts(rollups.where(F.col("bulkfile").isNotNull()), by=["bulkfile"])


def upload_summary(uploads: DataFrame, rollups: DataFrame) -> DataFrame:
    """Every registered upload with its rows, first and last day; ``rank`` numbers a channel's
    uploads, newest first.

    An upload without rows is still being processed.
    """
    counts = (
        rollups.where(F.col("bulkfile").isNotNull())
        .groupBy(F.col("bulkfile").alias("upload_id"))
        .agg(_hits(), F.min("first").alias("first"), F.max("last").alias("last"))
    )
    found = F.coalesce("hits", F.lit(0)).cast("bigint")
    newest = Window.partitionBy("channel_id").orderBy(F.col("upload_ms").desc(), "upload_id")
    return (
        uploads.join(counts, "upload_id", "left")
        .select(
            "channel_id",
            "upload_id",
            "upload_ms",
            "oname",
            found.alias("hits"),
            times.day_text("first").alias("first_day"),
            times.day_text("last").alias("last_day"),
            F.when(found == 0, "processing").otherwise("done").alias("state"),
        )
        .withColumn("rank", F.row_number().over(newest).cast("bigint"))
        .orderBy("channel_id", "rank")
    )
