"""Channel dashboards: daily counts, counts by field, totals, uploads, the data browser."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import times
from kindred.operators import filters, ranking
from kindred.operators.cooccurrence import BY_CHANNEL

# Rows the data browser shows, and the relative error of approximate distinct
# counts.
BROWSER_ROWS = 100
DISTINCT_ERROR = 0.01


def _hits() -> Column:
    return F.count(F.lit(1)).alias("hits")


def daily_counts(
    rows: DataFrame, by: Sequence[str] = BY_CHANNEL, ingestion: str | None = None
) -> DataFrame:
    """Rows per UTC day, optionally of one ingestion type."""
    rows = filters.of_ingestion(rows, ingestion)
    counts = rows.groupBy(*by, F.to_date("time").alias("day")).agg(_hits())
    return counts.withColumn("day", times.day_text("day"))


def fill_days(counts: DataFrame, by: Sequence[str] = BY_CHANNEL) -> DataFrame:
    """Daily counts with zeros for the days between each group's first and last day."""
    days = F.sequence(F.to_date(F.min("day")), F.to_date(F.max("day")))
    spans = counts.groupBy(*by).agg(days.alias("days"))
    dates = spans.select(*by, F.explode("days").alias("date"))
    calendar = dates.select(*by, F.col("date").cast("string").alias("day"))
    return calendar.join(counts, [*by, "day"], "left").select(
        *by, "day", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits")
    )


def counts_by(
    rows: DataFrame, field: str, by: Sequence[str] = BY_CHANNEL, size: int | None = None
) -> DataFrame:
    """Rows per value of a field: all values, or the ``size`` most frequent of each channel."""
    counts = rows.where(F.col(field).isNotNull()).groupBy(*by, field).agg(_hits())
    if size is None:
        return counts
    return ranking.top_k(counts, by, [F.col("hits").desc(), F.col(field)], size).drop("rank")


def totals(rows: DataFrame, by: Sequence[str] = BY_CHANNEL, exact: bool = True) -> DataFrame:
    """Rows, distinct users and distinct items of each channel.

    The approximate form keeps one small sketch per channel and needs no shuffle of users.
    """
    if exact:
        users, items = F.count_distinct("user_id"), F.count_distinct("item_id")
    else:
        users = F.approx_count_distinct("user_id", DISTINCT_ERROR)
        items = F.approx_count_distinct("item_id", DISTINCT_ERROR)
    return rows.groupBy(*by).agg(
        _hits(), users.alias("distinct_users"), items.alias("distinct_items")
    )


def facets(rows: DataFrame) -> DataFrame:
    """All counts of the channel page from one scan: per day, ingestion type, action, total."""
    facet = F.when(F.grouping("day") == 0, "day").when(
        F.grouping("ingestion") == 0, "ingestion"
    )
    named = facet.when(F.grouping("action") == 0, "action").otherwise("total")
    days = rows.select("channel_id", "ingestion", "action", F.to_date("time").alias("day"))
    sets = [["channel_id", name] for name in ("day", "ingestion", "action")] + [["channel_id"]]
    return (
        days.groupingSets(sets, "channel_id", "day", "ingestion", "action")
        .agg(
            named.alias("facet"),
            F.coalesce(times.day_text("day"), "ingestion", "action").alias("value"),
            _hits(),
            F.count_if(F.col("ingestion") == "stream").alias("stream_hits"),
        )
        .select("channel_id", "facet", "value", "hits", "stream_hits")
    )


def upload_daily_counts(rows: DataFrame) -> DataFrame:
    """Rows per upload and day."""
    uploaded = rows.where(F.col("bulkfile").isNotNull())
    return daily_counts(uploaded, by=["bulkfile"])


def upload_summary(uploads: DataFrame, rows: DataFrame) -> DataFrame:
    """Every registered upload with its rows, first and last day; ``rank`` numbers a channel's
    uploads, newest first.

    An upload without rows is still being processed.
    """
    counts = (
        rows.where(F.col("bulkfile").isNotNull())
        .groupBy(F.col("bulkfile").alias("upload_id"))
        .agg(_hits(), F.min("time").alias("first"), F.max("time").alias("last"))
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


def browse(
    rows: DataFrame, by: Sequence[str] = BY_CHANNEL, size: int = BROWSER_ROWS
) -> DataFrame:
    """The newest rows of every channel; ``totals`` gives their number."""
    order = [F.col("time").desc(), *map(F.col, ("user_id", "item_id", "action", "rating"))]
    return ranking.top_k(rows, by, order, size)
