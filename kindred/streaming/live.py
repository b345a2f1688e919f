"""Live counts of a stream per channel and window of event time, with a watermark.

The watermark of a stream is the latest event time of all batches before, less a delay. A window that
ends by then is closed: its count is final, and rows that still come for it are counted as late and
change nothing. Each batch adds its counts, its late rows and its own latest time in one commit, so
a batch that is repeated after a failure meets the same watermark and counts once.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.operators import deltas
from kindred.sources import batches, parsing
from kindred.streaming.ingest import BATCH_INTERVAL

WINDOW, DELAY = "1 hour", "10 minutes"
KEYS = ("channel_id", "window_start", "window_end")
COUNTS = "channel_id string, window_start timestamp, window_end timestamp, hits bigint"


def _counts(name: str) -> batches.Table:
    return batches.Table(
        name,
        COUNTS,
        lambda: F.date_format("window_start", "yyyy-MM"),
        lambda rows: deltas.summed(rows, (*KEYS, batches.OWNER), ("hits",)),
        order=("window_start",),
    )


LIVE, LATE = _counts("live_counts"), _counts("late_counts")
# The latest event time of each batch of a stream.
TIMES = batches.Table(
    "live_times", "stream string, batch bigint, latest timestamp", lambda: F.lit("all"), partitions=()
)
TABLES = [LIVE, LATE, TIMES]


def _folder(root: str) -> str:
    return f"{root}/live"


def watermark(spark: SparkSession, root: str, stream: str, delay: str = DELAY, before: int | None = None):
    """Until when windows are closed, after all batches of a stream or those before a number; None
    before the first event."""
    mine = batches.read(spark, _folder(root), TIMES).where(F.col("stream") == stream)
    if before is not None:
        mine = mine.where(F.col("batch") < before)
    return mine.agg(F.max("latest") - F.expr(f"INTERVAL {delay}")).first()[0]


def count_batch(
    parsed: DataFrame, stream: str, batch: int, root: str, window: str = WINDOW, delay: str = DELAY
) -> None:
    """Add the good rows of one parsed batch to the counts."""
    spark = parsed.sparkSession
    closed = watermark(spark, root, stream, delay, before=batch)
    rows = parsing.accepted(parsed).select("channel_id", "time", F.window("time", window).alias("window"))
    counted = (
        rows.groupBy("channel_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"))
        .agg(F.count(F.lit(1)).alias("hits"), F.max("time").alias("latest"))
        .persist()
    )
    try:
        late = F.col("window_end") <= F.lit(closed) if closed is not None else F.lit(False)
        latest = counted.agg(F.max("latest").alias("latest")).select(
            F.lit(stream).alias("stream"), F.lit(batch).cast("bigint").alias("batch"), "latest"
        )
        outputs = {
            LIVE: counted.where(~late).drop("latest"),
            LATE: counted.where(late).drop("latest"),
            TIMES: latest.where("latest IS NOT NULL"),
        }
        batches.write(outputs, _folder(root), stream, batch)
    finally:
        counted.unpersist()


def count(
    messages: DataFrame,
    root: str,
    checkpoint: str,
    window: str = WINDOW,
    delay: str = DELAY,
    available_now: bool = False,
) -> StreamingQuery:
    """Start counting a stream of message lines."""
    trigger = {"availableNow": True} if available_now else {"processingTime": BATCH_INTERVAL}
    known, started = {}, threading.Event()

    def add(batch: DataFrame, number: int) -> None:
        started.wait()
        count_batch(batch, known["id"], number, root, window, delay)

    query = (
        parsing.parse_messages(messages)
        .writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
    known["id"] = query.id
    started.set()
    return query


def counts(spark: SparkSession, root: str, stream: str, delay: str = DELAY) -> DataFrame:
    """Rows per channel and window, whether the window is closed, and how many rows came too late."""
    closed = watermark(spark, root, stream, delay)
    # A window may have late rows alone.
    hits = batches.read(spark, _folder(root), LIVE).withColumn("late", F.lit(0).cast("bigint"))
    late = batches.read(spark, _folder(root), LATE).select(*KEYS, F.lit(0).cast("bigint").alias("hits"), F.col("hits").alias("late"))
    summed = deltas.summed(hits.unionByName(late), KEYS, ("hits", "late"))
    is_closed = F.col("window_end") <= F.lit(closed) if closed is not None else F.lit(False)
    return summed.withColumn("closed", is_closed)


def compact(spark: SparkSession, root: str) -> int | None:
    return batches.compact(spark, _folder(root), TABLES)
