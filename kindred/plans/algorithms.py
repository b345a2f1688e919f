"""Running algorithms: from a definition to a published, versioned result."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import text
from kindred.operators import content, factorize, filters, items, ranking, recommend, similarity
from kindred.sources import tables

SUCCESS, FAILURE = "success", "failure"


@dataclass(frozen=True)
class Algorithm:
    """One configured algorithm of a channel. No actions means all of them.

    ``missing_values`` is the policy of a content-based algorithm for empty numeric attributes.
    """

    channel_id: str
    algo_id: str
    base: str
    actions: Sequence[str] = ()
    missing_values: str = content.ZERO

    def __post_init__(self):
        if self.base not in similarity.BASE_NAMES:
            raise ValueError(f"unknown base {self.base!r}; known: {similarity.BASE_NAMES}")

    @property
    def factorised(self) -> bool:
        return self.base in similarity.FACTORISATIONS

    @property
    def by_content(self) -> bool:
        return self.base == similarity.CONTENT

    @property
    def kind(self) -> str:
        """The table its versions are in."""
        if self.by_content:
            return tables.VECTORS
        return tables.RECOMMENDATIONS if self.factorised else tables.SIMILARITY


def stored(spark: SparkSession, root: str, channel: str, algo: str) -> Algorithm | None:
    """An algorithm from its row in the catalog; its actions are a JSON list there."""
    rows = tables.read_catalog(spark, root, tables.ALGORITHMS)
    wanted = (F.col("channel_id") == channel) & (F.col("algo_id") == algo)
    row = rows.where(wanted).withColumn("actions", text.actions_from_json("actions")).first()
    if row is None:
        return None
    policy = row["missing_values"] or content.ZERO
    return Algorithm(channel, algo, row["base"], tuple(row["actions"] or ()), policy)


def parse_parameters(text: str) -> dict[str, str | list[str]]:
    """``actions=a,b#algoId=X`` as a dict; parameters without a value are left out."""
    pairs = (parameter.partition("=") for parameter in text.split("#"))
    named = {name: value.strip() for name, _, value in pairs if value.strip()}
    return {n: v.split(",") if n == "actions" else v for n, v in named.items()}


def compute_vectors(spark: SparkSession, root: str, algorithm: Algorithm) -> DataFrame:
    """The prepared attributes of the channel's items."""
    channel = algorithm.channel_id
    declared = tables.read_catalog(spark, root, tables.ATTRIBUTES)
    attributes = items.declared_attributes(declared, channel)
    known = tables.read_items(spark, root, channel, attributes)
    return content.vectors(known, attributes, algorithm.missing_values)


def compute(interactions: DataFrame, algorithm: Algorithm) -> DataFrame:
    """The result rows of an algorithm over its channel's interactions."""
    rows = filters.of_channel(interactions, algorithm.channel_id)
    if algorithm.factorised:
        rows = filters.of_actions(rows, algorithm.actions)
        return factorize.predictions(rows, implicit=algorithm.base == "alsimplicit")
    pairs = similarity.similarity(rows, algorithm.base, algorithm.actions, by=())
    return similarity.symmetric(pairs)


def run(
    spark: SparkSession, root: str, interactions: DataFrame | None, algorithm: Algorithm
) -> str:
    """Compute and publish the next version; returns it. Content-based algorithms read the items
    and attributes under ``root`` and no interactions.

    The version is claimed first, so runs at once write different ones. A failed run is recorded
    and raised again; the served version stays, and the next run takes the number and overwrites
    whatever this one left.
    """
    channel, algo = algorithm.channel_id, algorithm.algo_id
    version = tables.claim_version(spark, root, channel, algo)
    start_ms = int(time.time() * 1000)
    outcome, output = FAILURE, ""
    try:
        if algorithm.by_content:
            rows = compute_vectors(spark, root, algorithm)
        else:
            rows = compute(interactions, algorithm)
        tables.write_result(rows, root, algorithm.kind, channel, algo, version)
        outcome = SUCCESS
    except Exception as error:
        output = str(error)
        tables.release_version(spark, root, channel, algo, version)
        raise
    finally:
        tables.record_run(
            spark,
            root,
            channel_id=channel,
            algo_id=algo,
            version=version,
            start_ms=start_ms,
            end_ms=int(time.time() * 1000),
            outcome=outcome,
            output=output,
        )
    return version


def serve(
    spark: SparkSession, root: str, algorithm: Algorithm, num: int | None
) -> DataFrame:
    """Recommendations for all users of a channel from the current version.

    Factorised algorithms serve their stored predictions, the others weigh similarities by
    each user's history.
    """
    if algorithm.by_content:
        raise ValueError("content-based algorithms answer for one item: requests.similar_items")
    kind = algorithm.kind
    current = filters.of_channel(tables.current_results(spark, root, kind), algorithm.channel_id)
    current = current.where(current["algo_id"] == algorithm.algo_id)
    if algorithm.factorised:
        best = ranking.stored_recommendations(current, num)
        return best.select("channel_id", "user_id", "item_id", "score", "rank")
    history = filters.of_channel(tables.read_history(spark, root), algorithm.channel_id)
    similarities = current.select("channel_id", "item_id", "other_id", "score")
    return recommend.recommendations(history, similarities, num)
