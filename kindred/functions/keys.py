"""Composite keys, padded numbers and time-based ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Width of padded scores and versions, and the id prefixes.
PAD_WIDTH = 6
CLIENT_PREFIX = "CL-"
CHANNEL_PREFIX = "CH-"
ALGO_PREFIX = "AL-"


def padded(number: Column, width: int = PAD_WIDTH) -> Column:
    """Left-pad with zeros; longer numbers stay whole (``lpad`` alone would cut them)."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def joined(*parts: Column | str) -> Column:
    return F.concat_ws(":", *parts)


def part(key: Column | str, index: int) -> Column:
    """The ``index``-th colon-separated part of a key, NULL when the key is shorter."""
    return F.try_element_at(F.split(key, ":"), F.lit(index + 1))


def history_key(channel: Column | str, user: Column | str) -> Column:
    return joined(channel, user)


def result_key(
    channel: Column | str, algo: Column | str, subject: Column | str, version: Column | str
) -> Column:
    """Key of a published row: channel and algorithm lower-cased, then subject and version."""
    return joined(F.lower(channel), F.lower(algo), subject, version)


def algo_key(channel: Column | str, algo: Column | str) -> Column:
    return joined(F.upper(channel), F.upper(algo))


def timed_id(prefix: str, millis: Column) -> Column:
    return F.concat(F.lit(prefix), F.upper(F.hex(millis)))


def id_millis(timed: Column | str) -> Column:
    """The creation time inside a time-based id, as epoch milliseconds."""
    return F.conv(F.element_at(F.split(timed, "-"), -1), 16, 10).cast("bigint")


# Fixed value: characters that Spark escapes in the names of partition folders, beside controls.
ESCAPED = '"#%\'*/:=?\\{[]^\x7f'


def folder_value(value: str) -> str:
    """A partition value as it stands in a folder name, which Spark reads back as the value."""
    return "".join(f"%{ord(c):02X}" if c in ESCAPED or c < " " else c for c in value)


def item_document_id(channel: Column | str, item: Column | str) -> Column:
    """A 64-bit surrogate for (channel, item); the pair itself stays the real key."""
    return F.xxhash64(joined(channel, item))
