"""One parser for bulk lines and stream messages.

Lines are comma-separated without quoting. A parsed frame keeps the raw line and a ``reason``
column: NULL for good rows, so good rows and rejects are two filters over the same plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import text, times

# Reasons for rejecting a line.
REASONS = {
    "fields": "too few fields",
    "user": "user is not a number",
    "item": "item is not a number",
    "time": "time is not a time",
    "rating": "rating is not a number",
}
# Positions of the fields in a bulk line and in a stream message.
BULK_FIELDS = {"user": 0, "item": 1, "time": 2, "action": 3, "rating": 4}
STREAM_FIELDS = {
    "client": 0, "channel": 1, "user": 2, "item": 3, "time": 4, "action": 5, "rating": 6,
}

PARSED_COLUMNS = (
    "client_id", "channel_id", "ingestion", "bulkfile",
    "user_id", "item_id", "time", "action", "rating",
)


def _typed(lines: DataFrame, column: str, at: dict[str, int], constants: dict[str, Column]):
    parts = F.col("parts")
    count = F.size(parts)
    needed = at["action"] + 1
    # A rating is read only from a line of exactly the right length; longer lines load without.
    rating_text = F.when(count == at["rating"] + 1, text.field(parts, at["rating"]))
    rating = text.number(rating_text)
    split = lines.select(F.col(column).alias("raw"), text.fields(column).alias("parts"))
    typed = split.select(
        "raw",
        *[value.alias(name) for name, value in constants.items()],
        text.field(parts, at["user"]).try_cast("bigint").alias("user_id"),
        text.field(parts, at["item"]).try_cast("bigint").alias("item_id"),
        times.parsed(text.field(parts, at["time"])).alias("time"),
        text.field(parts, at["action"]).alias("action"),
        rating.alias("rating"),
        (count < needed).alias("short"),
        (rating_text.isNotNull() & rating.isNull()).alias("bad_rating"),
    )
    reason = (
        F.when(F.col("short"), REASONS["fields"])
        .when(F.col("user_id").isNull(), REASONS["user"])
        .when(F.col("item_id").isNull(), REASONS["item"])
        .when(F.col("time").isNull(), REASONS["time"])
        .when(F.col("bad_rating"), REASONS["rating"])
    )
    return typed.select(*PARSED_COLUMNS, "raw", reason.alias("reason"))


def parse_bulk(
    lines: DataFrame, client: str, channel: str, upload: str, column: str = "value"
) -> DataFrame:
    """``user,item,time,action[,rating]`` lines of one upload."""
    constants = {
        "client_id": F.lit(client),
        "channel_id": F.lit(channel),
        "ingestion": F.lit("bulk"),
        "bulkfile": F.lit(upload),
    }
    return _typed(lines, column, BULK_FIELDS, constants)


def parse_messages(lines: DataFrame, column: str = "value") -> DataFrame:
    """``client,channel,user,item,time,action`` messages; a seventh field is a rating."""
    constants = {
        "client_id": text.field(F.col("parts"), STREAM_FIELDS["client"]),
        "channel_id": text.field(F.col("parts"), STREAM_FIELDS["channel"]),
        "ingestion": F.lit("stream"),
        "bulkfile": F.lit(None).cast("string"),
    }
    return _typed(lines, column, STREAM_FIELDS, constants)


# What makes two parsed lines the same: all values that were read, and for bad lines their text.
SAME = (*PARSED_COLUMNS, "bad_line")


def without_repeats(parsed: DataFrame, within: str | None = None) -> DataFrame:
    """Parsed lines without repeated ones.

    In a stream, a line is repeated if the same one arrived no longer than ``within`` before (such
    as "10 minutes"); what is remembered of older ones is dropped, so the state stays bounded by
    the lines of that time. It goes by arrival, so no line is too late. In a batch, all lines of the
    batch are compared.
    """
    marked = parsed.withColumn("bad_line", F.when(F.col("reason").isNotNull(), F.col("raw")))
    if not parsed.isStreaming:
        return marked.dropDuplicates(list(SAME)).drop("bad_line")
    if within is None:
        raise ValueError("a stream needs a time within which lines are compared")
    arrived = marked.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", within)
    return arrived.dropDuplicatesWithinWatermark(list(SAME)).drop("bad_line", "arrived")


def for_tables(parsed: DataFrame) -> DataFrame:
    """Parsed lines with the text of bad ones alone: all that the tables need, and less to keep."""
    return parsed.withColumn("raw", F.when(F.col("reason").isNotNull(), F.col("raw")))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).select(*PARSED_COLUMNS)


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).select(
        "raw", "reason", F.col("ingestion").alias("source")
    )


def encode_messages(interactions: DataFrame) -> DataFrame:
    """Interactions as stream messages in ``value``, ready for a Kafka or text writer."""
    return interactions.select(
        F.concat_ws(
            ",",
            "client_id",
            "channel_id",
            "user_id",
            "item_id",
            times.seconds_text("time"),
            "action",
        ).alias("value")
    )
