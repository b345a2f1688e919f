"""Item metadata: declared attributes, validated writes, coverage and profiles."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred import schemas
from kindred.functions import keys, text, times
from kindred.operators import dashboard, filters

# Attribute types.
NUMERIC, CATEGORICAL = "numeric", "categorical"

# Declared attributes: key -> (label, type).
Attributes = Mapping[str, tuple[str, str]]

SUBMISSION = ("channel_id", "item_id", "seq")


def declared_attributes(schema_rows: DataFrame, channel: str) -> dict[str, tuple[str, str]]:
    """The attributes of one channel, from the attribute table: the columns of its typed items."""
    rows = filters.of_channel(schema_rows, channel).select("key", "name", "type").collect()
    return {row["key"]: (row["name"], row["type"]) for row in rows}


def declaration(spark: SparkSession, channel: str, attributes: Attributes) -> DataFrame:
    """Attribute table rows for one channel."""
    rows = [(channel, key, name, kind) for key, (name, kind) in attributes.items()]
    return spark.createDataFrame(rows, schemas.ATTRIBUTES)


def _undeclared(submissions: DataFrame, declared: DataFrame) -> DataFrame:
    """Submissions with the keys that their channel's attribute table lacks."""
    used = submissions.select(*SUBMISSION, F.explode(F.map_keys("attributes")).alias("key"))
    known = declared.select("channel_id", "key")
    return (
        used.join(known, ["channel_id", "key"], "left_anti")
        .groupBy(*SUBMISSION)
        .agg(F.array_join(F.sort_array(F.collect_set("key")), ",").alias("undeclared"))
    )


def valid(submissions: DataFrame, declared: DataFrame) -> DataFrame:
    """Submissions whose attributes are all in the attribute table."""
    return submissions.join(_undeclared(submissions, declared), [*SUBMISSION], "left_anti")


def accepted(
    submissions: DataFrame, declared: DataFrame, attributes: Attributes
) -> DataFrame:
    """Typed rows of submissions whose attributes are all declared."""
    return typed(valid(submissions, declared), attributes)


def typed(submissions: DataFrame, attributes: Attributes) -> DataFrame:
    """Submissions with one column per attribute.

    Submissions carry ``channel_id, item_id, seq`` and an ``attributes`` map of texts; a
    numeric attribute is the number its text starts with.
    """
    columns = [
        (
            text.leading_number(F.col("attributes")[key])
            if kind == NUMERIC
            else F.col("attributes")[key]
        ).alias(key)
        for key, (_, kind) in attributes.items()
    ]
    return submissions.select(*SUBMISSION, *columns)


def rejected(submissions: DataFrame, declared: DataFrame) -> DataFrame:
    """Submissions with an undeclared attribute: the whole record is refused."""
    return _undeclared(submissions, declared)


def latest(typed: DataFrame, attributes: Attributes) -> DataFrame:
    """The newest accepted record per item, replacing earlier ones as a whole."""
    newest = F.max_by(F.struct(*attributes), "seq").alias("newest")
    return (
        typed.groupBy("channel_id", "item_id")
        .agg(newest)
        .select(
            "channel_id",
            "item_id",
            keys.item_document_id("channel_id", "item_id").alias("document_id"),
            "newest.*",
        )
    )


def coverage(items: DataFrame, attributes: Attributes) -> DataFrame:
    """Items with a value per attribute, in one pass: above zero if numeric, else present."""

    def covered(key: str, kind: str) -> Column:
        return F.col(key) > 0 if kind == NUMERIC else F.col(key).isNotNull()

    counts = items.groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(covered(key, kind)).alias(key) for key, (_, kind) in attributes.items()],
    )
    unpivoted = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(key).alias("attribute"),
                    F.lit(label).alias("label"),
                    F.lit(kind).alias("type"),
                    F.col(key).alias("covered"),
                )
                for key, (label, kind) in attributes.items()
            ]
        )
    )
    return counts.select("channel_id", "total", unpivoted).withColumn(
        "percent", times.percent(F.col("covered"), F.col("total"))
    )


def profiles(items: DataFrame, attributes: Attributes) -> DataFrame:
    """The attributes each item has, with labels and types; filter by item for one profile."""
    pairs = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(label).alias("label"),
                    F.lit(kind).alias("type"),
                    F.col(key).cast("string").alias("value"),
                )
                for key, (label, kind) in attributes.items()
            ]
        )
    )
    return items.select("channel_id", "item_id", pairs).where(F.col("value").isNotNull())


def profile_counts(rows: DataFrame) -> DataFrame:
    """Daily counts of each item; filter by item for one profile."""
    return dashboard.daily_counts(rows, by=["channel_id", "item_id"])
