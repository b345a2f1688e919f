"""Clients and their channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import text, times


def clients_with_channels(clients: DataFrame, channels: DataFrame) -> DataFrame:
    """Every client with its channels, one row each; clients having channels come first.

    Channels join their client rather than clients their channels: an inner join may
    broadcast the clients or split a client with very many channels, a left join may not.
    """
    owned = channels.select(
        "client_id",
        "channel_id",
        F.col("name").alias("channel_name"),
        F.col("created_ms").alias("channel_created_ms"),
    )
    named = clients.select("client_id", "name", times.long_day("created_ms").alias("created"))
    having = named.join(owned, "client_id").withColumn("has_channels", F.lit(True))
    owners_seen = channels.select("client_id").distinct()
    lacking = named.join(owners_seen, "client_id", "left_anti").withColumn(
        "has_channels", F.lit(False)
    )
    return having.unionByName(lacking, allowMissingColumns=True).orderBy(
        F.col("has_channels").desc(), "client_id", "channel_id"
    )


def channel_counts(clients: DataFrame, channels: DataFrame) -> DataFrame:
    """The number of channels of every client."""
    counts = channels.groupBy("client_id").agg(F.count(F.lit(1)).alias("channels"))
    return clients.join(counts, "client_id", "left").select(
        "client_id", "name", F.coalesce("channels", F.lit(0)).cast("bigint").alias("channels")
    )


def search_clients(clients: DataFrame, search: str | None) -> DataFrame:
    """Clients whose name matches; without a search, all."""
    return clients.where(text.name_matches("name", search)) if search else clients


def channels_of(channels: DataFrame, client: str) -> DataFrame:
    """One client's channels, newest first, as ``rank`` numbers them."""
    newest = Window.partitionBy("client_id").orderBy(F.col("created_ms").desc(), "channel_id")
    return (
        channels.where(F.col("client_id") == client)
        .withColumn("created", times.long_day("created_ms"))
        .withColumn("rank", F.row_number().over(newest).cast("bigint"))
        .orderBy("rank")
    )


def owners(channels: DataFrame, clients: DataFrame) -> DataFrame:
    """Each channel with the name of its client."""
    names = clients.select("client_id", F.col("name").alias("client_name"))
    return channels.join(names, "client_id").select(
        "channel_id", "name", "client_id", "client_name"
    )
