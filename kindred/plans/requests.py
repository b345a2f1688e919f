"""Requests for one user, item, upload or channel over the tables under a root folder.

Each is the filtered form of an operator: the filters reach the partition folders and the
row-group statistics, so a request reads a small part of the tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators import (
    catalog,
    content,
    dashboard,
    filters,
    history,
    items,
    jobs,
    ranking,
    recommend,
    rollups,
)
from kindred.plans.algorithms import Algorithm, stored
from kindred.sources import batches, parsing, readers, tables


def _current(spark: SparkSession, root: str, kind: str, channel: str, algo: str) -> DataFrame:
    """The served version of one algorithm; its number is looked up first, so only the folder
    of that version is listed and read."""
    versions = tables.current_versions(tables.read_runs(spark, root))
    wanted = (F.col("channel_id") == channel) & (F.col("algo_id") == algo)
    found = versions.where(wanted).first()
    results = tables.read_results(spark, root, kind).where(wanted)
    return results.where(F.col("version") == (found["version"] if found else ""))


def similar_items(
    spark: SparkSession, root: str, channel: str, algo: str, item: int, num: int | None
) -> DataFrame:
    """From stored similarities, or for a content-based algorithm from its stored vectors."""
    algorithm = stored(spark, root, channel, algo)
    if algorithm and algorithm.by_content:
        prepared = _current(spark, root, tables.VECTORS, channel, algo)
        best = content.similar_by_vectors(prepared, item, num)
    else:
        current = _current(spark, root, tables.SIMILARITY, channel, algo)
        best = ranking.similar_to(current, item, num)
    return best.select(F.col("other_id").alias("item"), "score")


def compare_similar_items(
    spark: SparkSession, root: str, channel: str, algos: Sequence[str], item: int
) -> DataFrame:
    """One item's similar items side by side for several algorithms."""
    if not algos:
        empty = tables.read_results(spark, root, tables.SIMILARITY).limit(0)
        return ranking.compare_algorithms(empty).select(
            "algo_id", F.col("other_id").alias("item"), "score", "rank"
        )
    of_item = [
        _current(spark, root, tables.SIMILARITY, channel, algo).where(F.col("item_id") == item)
        for algo in algos
    ]
    rows = of_item[0]
    for more in of_item[1:]:
        rows = rows.unionByName(more)
    return ranking.compare_algorithms(rows).select(
        "algo_id", F.col("other_id").alias("item"), "score", "rank"
    )


def recommendations(
    spark: SparkSession, root: str, algorithm: Algorithm, user: int, num: int | None
) -> DataFrame:
    """Stored predictions of a factorised algorithm, or similarities weighed by history."""
    channel, algo = algorithm.channel_id, algorithm.algo_id
    if algorithm.factorised:
        stored = _current(spark, root, tables.RECOMMENDATIONS, channel, algo)
        mine = stored.where(F.col("user_id") == user)
        best = ranking.stored_recommendations(mine, num).orderBy("rank")
    else:
        current = _current(spark, root, tables.SIMILARITY, channel, algo)
        past = tables.read_history(spark, root).where(
            (F.col("channel_id") == channel) & (F.col("user_id") == user)
        )
        similarities = current.select("item_id", "other_id", "score")
        # Without channel and user columns the rows are those of a single user.
        best = recommend.recommendations_for(past, similarities, num)
    return best.select(F.col("item_id").alias("item"), "score")


def user_history(spark: SparkSession, root: str, channel: str, user: int) -> DataFrame:
    return history.user_history(tables.read_history(spark, root), channel, user)


def ingestion_chart(
    spark: SparkSession, root: str, channel: str, kind: str | None = None
) -> DataFrame:
    """Rows per day of a channel, bulk, streamed or both."""
    counts = filters.of_channel(tables.read_rollups(spark, root), channel)
    return rollups.daily_counts(counts, ingestion=kind).orderBy("day")


def channel_page(spark: SparkSession, root: str, channel: str) -> tuple[DataFrame, DataFrame]:
    """Counts per day, ingestion type and action, and the totals of a channel."""
    counts = filters.of_channel(tables.read_rollups(spark, root), channel)
    return rollups.facets(counts), rollups.totals(counts)


def audience(
    spark: SparkSession, root: str, channel: str, first: str | None = None, last: str | None = None
) -> DataFrame:
    """Rows and about how many distinct users and items a channel had in a range of days."""
    counts = filters.of_channel(tables.read_rollups(spark, root), channel)
    return rollups.totals(rollups.of_days(counts, first, last))


def data_browser(spark: SparkSession, root: str, channel: str) -> DataFrame:
    rows = filters.of_channel(tables.read_interactions(spark, root), channel)
    return dashboard.browse(rows).orderBy("rank")


def upload_chart(spark: SparkSession, root: str, upload: str) -> DataFrame:
    counts = filters.of_upload(tables.read_rollups(spark, root), upload)
    return rollups.upload_daily_counts(counts).orderBy("day")


def item_page(
    spark: SparkSession, root: str, channel: str, item: int, attributes: items.Attributes
) -> tuple[DataFrame, DataFrame]:
    """An item's labelled attributes and its rows per day."""
    known = tables.read_items(spark, root, channel, attributes)
    profile = items.profiles(filters.of_item(known, channel, item), attributes)
    rows = filters.of_item(tables.read_interactions(spark, root), channel, item)
    return profile, items.profile_counts(rows).orderBy("day")


def browser_total(spark: SparkSession, root: str, channel: str) -> DataFrame:
    """The number of rows beside the data browser."""
    counts = filters.of_channel(tables.read_rollups(spark, root), channel)
    return counts.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("total"))


def clients(spark: SparkSession, root: str, search: str | None = None) -> DataFrame:
    """Clients, all or those whose name matches, with their channels."""
    found = catalog.search_clients(tables.read_catalog(spark, root, tables.CLIENTS), search)
    return catalog.clients_with_channels(
        found, tables.read_catalog(spark, root, tables.CHANNELS)
    )


def channels(spark: SparkSession, root: str, client: str) -> DataFrame:
    return catalog.channels_of(tables.read_catalog(spark, root, tables.CHANNELS), client)


def owner(spark: SparkSession, root: str, channel: str) -> DataFrame:
    """A channel with the name of its client."""
    mine = filters.of_channel(tables.read_catalog(spark, root, tables.CHANNELS), channel)
    return catalog.owners(mine, tables.read_catalog(spark, root, tables.CLIENTS))


def uploads(spark: SparkSession, root: str, channel: str) -> DataFrame:
    """Registered uploads of a channel with what was loaded from them."""
    mine = filters.of_channel(tables.read_catalog(spark, root, tables.UPLOADS), channel)
    counts = filters.of_channel(tables.read_rollups(spark, root), channel)
    return rollups.upload_summary(mine, counts)


def coverage(spark: SparkSession, root: str, channel: str) -> DataFrame:
    """How many items of a channel have each declared attribute."""
    declared = tables.read_catalog(spark, root, tables.ATTRIBUTES)
    attributes = items.declared_attributes(declared, channel)
    return items.coverage(tables.read_items(spark, root, channel, attributes), attributes)


def job_history(spark: SparkSession, root: str, channel: str, algo: str) -> DataFrame:
    return jobs.history_of(tables.read_runs(spark, root), channel, algo)


def load_registered(spark: SparkSession, root: str, upload: str) -> None:
    """Load an upload whose path, time and channel are in the catalog."""
    registered = tables.read_catalog(spark, root, tables.UPLOADS)
    row = registered.where(F.col("upload_id") == upload).first()
    if row is None:
        raise ValueError(f"upload {upload} is not registered")
    channel = row["channel_id"]
    of = tables.read_catalog(spark, root, tables.CHANNELS).where(F.col("channel_id") == channel)
    owner = of.first()
    if owner is None:
        raise ValueError(f"channel {channel} of upload {upload} is not registered")
    load_upload(spark, root, row["path"], owner["client_id"], channel, upload, row["upload_ms"])


def load_upload(
    spark: SparkSession,
    root: str,
    path: str,
    client: str,
    channel: str,
    upload: str,
    upload_ms: int,
    dedup: bool = False,
) -> None:
    """Load an uploaded file into all tables, and its bad lines into the rejects.

    ``upload_ms`` orders this load among others in the history. The lines are parsed once for all
    tables. Loading an upload again replaces its rows, also those that were merged meanwhile; a load
    that breaks off leaves what was there. With ``dedup`` repeated lines of the file count once.
    """
    parsed = parsing.parse_bulk(readers.bulk_lines(spark, path), client, channel, upload)
    parsed = parsing.for_tables(parsing.without_repeats(parsed) if dedup else parsed).persist()
    try:
        good = parsing.accepted(parsed)
        past = history.from_interactions(good, F.lit(upload_ms))
        outputs = tables.ingested(good, past, parsing.rejected(parsed))
        number = batches.next_batch(spark, root, upload)
        batches.write(outputs, root, upload, number, batches.LATEST)
    finally:
        parsed.unpersist()
