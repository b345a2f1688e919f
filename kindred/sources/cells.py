"""Key-value cells and the records they make up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import keys


def with_prefix(cells: DataFrame, prefix: str) -> DataFrame:
    """Cells whose row key starts with a prefix; pushed to the scan."""
    return cells.where(F.col("rowkey").startswith(prefix))


def to_records(cells: DataFrame, qualifiers: Sequence[str], family: str = "info") -> DataFrame:
    """One row per row key with a column per qualifier.

    The qualifiers are named, so each record is a few partial maxima rather than a collected
    list, however many cells a row key has.
    """
    columns = [
        F.max(F.when(F.col("qualifier") == name, F.col("value"))).alias(name)
        for name in qualifiers
    ]
    wanted = (F.col("family") == family) & F.col("qualifier").isin(list(qualifiers))
    return cells.where(wanted).groupBy("rowkey").agg(*columns)


def from_records(
    records: DataFrame, rowkey: str, qualifiers: Sequence[str], family: str = "info"
) -> DataFrame:
    """Records back to cells; missing values give no cell."""
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("qualifier"), F.col(name).cast("string").alias("value"))
            for name in qualifiers
        ]
    )
    return records.select(
        F.col(rowkey).alias("rowkey"), F.lit(family).alias("family"), F.inline(pairs)
    ).where(F.col("value").isNotNull())


def similarity_cells(similarities: DataFrame) -> DataFrame:
    """Published similarities as cells: padded score and other item in the qualifier."""
    return similarities.select(
        keys.result_key("channel_id", "algo_id", "item_id", "version").alias("rowkey"),
        F.lit("s").alias("family"),
        keys.joined(keys.padded(F.col("score")), "other_id").alias("qualifier"),
        F.lit("1").alias("value"),
    )


def recommendation_cells(recommendations: DataFrame) -> DataFrame:
    """Published predictions as cells: item in the qualifier, score in the value."""
    return recommendations.select(
        keys.result_key("channel_id", "algo_id", "user_id", "version").alias("rowkey"),
        F.lit("r").alias("family"),
        F.col("item_id").cast("string").alias("qualifier"),
        F.col("score").cast("string").alias("value"),
    )


def similarities_from_cells(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("family") == "s").select(
        keys.part("rowkey", 0).alias("channel_id"),
        keys.part("rowkey", 1).alias("algo_id"),
        keys.part("rowkey", 3).alias("version"),
        keys.part("rowkey", 2).cast("bigint").alias("item_id"),
        keys.part("qualifier", 1).cast("bigint").alias("other_id"),
        keys.part("qualifier", 0).cast("bigint").alias("score"),
    )
