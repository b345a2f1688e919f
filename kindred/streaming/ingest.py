"""Streaming ingestion of messages into the interaction and history tables."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.operators import history
from kindred.sources import batches, parsing, tables

# Fixed value: how often a continuously running stream takes a batch.
BATCH_INTERVAL = "1 second"


def write_batch(parsed: DataFrame, stream_id: str, batch_id: int, root: str) -> None:
    """Write one parsed batch to all tables, and its bad lines to the rejects.

    The batch becomes visible in all tables at once. One that runs again after a failure counts
    once, whether it was merged meanwhile or not, and streams don't touch each other's rows.
    ``taken_ms``, the time of the batch, places its rows in the history; rows without it count as
    loaded first.
    """
    rows = parsing.for_tables(parsed).persist()
    try:
        taken = F.col("taken_ms") if "taken_ms" in rows.columns else F.lit(0)
        past = history.from_interactions(rows.where(F.col("reason").isNull()), taken)
        outputs = tables.ingested(parsing.accepted(rows), past, parsing.rejected(rows))
        batches.write(outputs, root, stream_id, batch_id)
    finally:
        rows.unpersist()


def ingest(
    messages: DataFrame,
    root: str,
    checkpoint: str,
    available_now: bool = False,
    dedup_within: str | None = None,
) -> StreamingQuery:
    """Start a stream from message lines (a ``value`` column) into the tables under ``root``.

    A stream is known by the id that Spark keeps in its checkpoint. The time of a batch is kept
    there too, so rows written again after a failure have the same place in the history. It is on
    the scale of ``upload_ms`` of bulk loads: of two writes to one key the later one wins. With
    ``dedup_within`` a message that arrived before within that time is left out.
    """
    trigger = {"availableNow": True} if available_now else {"processingTime": BATCH_INTERVAL}
    known, started = {}, threading.Event()

    def write(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        write_batch(batch, known["id"], batch_id, root)

    taken_ms = F.unix_millis(F.current_timestamp())
    parsed = parsing.parse_messages(messages)
    if dedup_within is not None:
        parsed = parsing.without_repeats(parsed, dedup_within)
    query = (
        parsed.withColumn("taken_ms", taken_ms)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
    known["id"] = query.id
    started.set()
    return query
