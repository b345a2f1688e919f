"""Time expressions. The session time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats of input and output times.
INPUT_FORMAT = "yyyy-M-d H:m:s"
SECONDS_FORMAT = "yyyy-MM-dd HH:mm:ss"
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
LONG_DAY_FORMAT = "d MMMM, yyyy"


def parsed(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(INPUT_FORMAT))


def epoch_seconds(time: Column | str) -> Column:
    return F.unix_timestamp(time)


def seconds_text(time: Column | str) -> Column:
    return F.date_format(time, SECONDS_FORMAT)


def iso_text(time: Column | str) -> Column:
    return F.date_format(time, ISO_FORMAT)


def long_day(millis: Column | str) -> Column:
    """Epoch milliseconds as ``1 March, 2016``."""
    return F.date_format(F.timestamp_millis(millis), LONG_DAY_FORMAT)


def day_text(time: Column | str) -> Column:
    return F.date_format(time, "yyyy-MM-dd")


def humanised(millis: Column) -> Column:
    """A duration in whole seconds below a minute, hours above an hour, else minutes."""

    def whole(unit_ms: int) -> Column:
        return (millis / unit_ms).cast("bigint").cast("string")

    return (
        F.when(millis < 60_000, F.concat(whole(1_000), F.lit(" secs")))
        .when(millis > 3_600_000, F.concat(whole(3_600_000), F.lit(" hrs")))
        .otherwise(F.concat(whole(60_000), F.lit(" min")))
    )


def percent(part: Column, whole: Column) -> Column:
    """Truncated percentage; NULL of nothing."""
    return F.floor(F.try_divide(part, whole) * 100).cast("bigint")
