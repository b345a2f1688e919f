"""Cutting hot keys into parts of bounded size, and spreading rows before a fan-out.

A key may hold a large share of all rows. Counting rows per key is cheap (map-side partial
counts, one row per key in the shuffle), and the keys above a limit are few, so the join that
brings their part counts back is broadcast by adaptive execution unless it turns out large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pieces in which the rows of a key meet its number of parts.
JOIN_SALTS = 64


def measured(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Put an aggregate behind a shuffle of its own, by the keys it is joined on.

    Adaptive execution judges a join side by its last shuffle. Without this one that is the
    shuffle before the final aggregation and its filters, which may be many times larger; with
    it a small side is seen to be small and broadcast, and an empty one drops the join.
    """
    return rows.hint("rebalance", *keys)


def hot_keys(rows: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows and the number of parts each is cut into."""
    hot = (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("rows_of_key"))
        .where(F.col("rows_of_key") > limit)
        .select(*keys, F.ceil(F.col("rows_of_key") / limit).cast("int").alias("parts"))
    )
    return measured(hot, keys)


def with_parts(
    rows: DataFrame, hot: DataFrame, keys: Sequence[str], spread_by: str | None = None
) -> DataFrame:
    """Add ``parts``: 1 for ordinary keys.

    Where a key may hold most of the rows, they are spread by a hash of ``spread_by`` for the join,
    and the few hot keys are repeated.
    """
    on = list(keys)
    if spread_by:
        on = [*keys, "salt"]
        rows = rows.withColumn("salt", part_of(spread_by, F.lit(JOIN_SALTS)))
        hot = hot.withColumn("salt", F.explode(all_parts(F.lit(JOIN_SALTS))))
    found = rows.join(hot, on, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return found.drop("salt") if spread_by else found


def part_of(column: Column | str, parts: Column | str = "parts") -> Column:
    parts = F.col(parts) if isinstance(parts, str) else parts
    return F.pmod(F.xxhash64(column), parts).cast("int")


def all_parts(parts: Column | str = "parts") -> Column:
    parts = F.col(parts) if isinstance(parts, str) else parts
    return F.sequence(F.lit(0), parts - 1)


def spread(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash-partition into as many partitions as the session has for shuffles.

    For the inputs of a join whose output is many times larger. Adaptive execution would
    merge partitions by the size of these inputs and leave the output to a few tasks; it does
    not merge partitions whose number was given.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, *keys)


def salted_join(
    large: DataFrame, other: DataFrame, keys: Sequence[str], spread_by: str, limit: int
) -> DataFrame:
    """Inner join on ``keys`` in which no task gets more than about ``limit`` rows of a hot key.

    The rows of a hot key in ``large`` are spread by a hash of ``spread_by``; the matching
    rows of ``other`` are repeated once per part. Ordinary keys are joined as they are.
    """
    hot = hot_keys(large, keys, limit)
    salted = [*keys, "salt"]
    left = with_parts(large, hot, keys).withColumn("salt", part_of(spread_by))
    right = with_parts(other, hot, keys).withColumn("salt", F.explode(all_parts()))
    joined = spread(left.drop("parts"), salted).join(spread(right.drop("parts"), salted), salted)
    return joined.drop("salt")
