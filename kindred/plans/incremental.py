"""Similarity algorithms kept up to date batch by batch.

    pair_rows     distinct (user, item, rating) that an algorithm has seen
    pair_sums     users and rating sums per pair, one row per batch or compaction
    pair_items    users per item, likewise

A batch adds to all three at once; one that is given again adds nothing. Reading sums the rows, and
compacting the tables adds them up for good. Of the rows seen before, a batch reads those in the
parts of its own users.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import scores
from kindred.operators import cooccurrence, deltas, filters, similarity
from kindred.plans.algorithms import Algorithm
from kindred.sources import batches

OF = ("channel_id", "algo_id")
PAIR = (*OF, "item_id", "other_id")
# Parts of an algorithm's users, and of its pairs and items.
USER_PARTS, PAIR_PARTS = 256, 16


def _part(parts: int, *columns: str):
    return F.pmod(F.xxhash64(*columns), F.lit(parts)).cast("string")


ROWS = batches.Table(
    "pair_rows",
    "channel_id string, algo_id string, user_id bigint, item_id bigint, rating double",
    partial(_part, USER_PARTS, "user_id"),
    partitions=OF,
    order=("user_id",),
)
SUMS = batches.Table(
    "pair_sums",
    "channel_id string, algo_id string, item_id bigint, other_id bigint, n bigint, "
    + ", ".join(f"{name} double" for name in deltas.PRODUCTS),
    partial(_part, PAIR_PARTS, "item_id", "other_id"),
    partial(deltas.summed, keys=(*PAIR, batches.OWNER), values=deltas.ADDED),
    partitions=OF,
    order=("item_id", "other_id"),
)
ITEMS = batches.Table(
    "pair_items",
    "channel_id string, algo_id string, item_id bigint, users bigint",
    partial(_part, PAIR_PARTS, "item_id"),
    partial(deltas.summed, keys=(*OF, "item_id", batches.OWNER), values=("users",)),
    partitions=OF,
    order=("item_id",),
)
TABLES = [ROWS, SUMS, ITEMS]


def _folder(root: str) -> str:
    """A root of its own: other batches are numbered and merged on their own."""
    return f"{root}/pairs"


def _source(algorithm: Algorithm) -> str:
    return f"{algorithm.channel_id}:{algorithm.algo_id}"


def _of(rows: DataFrame, algorithm: Algorithm) -> DataFrame:
    mine = (F.col("channel_id") == algorithm.channel_id) & (F.col("algo_id") == algorithm.algo_id)
    return rows.where(mine).drop(*OF)


def update(spark: SparkSession, root: str, algorithm: Algorithm, interactions: DataFrame, batch: int) -> bool:
    """Add a batch of interactions of the algorithm's channel; False if it was added before.

    Batches of one algorithm are numbered 0, 1, … and added one after the other.
    """
    if algorithm.base not in (*similarity.COUNT_SCORES, similarity.PEARSON):
        raise ValueError(f"{algorithm.base} is not kept up by pairs")
    if batches.is_committed(spark, _folder(root), _source(algorithm), batch):
        return False
    mine = filters.of_channel(interactions, algorithm.channel_id)
    mine = filters.for_algorithm(mine, algorithm.base, algorithm.actions)
    if algorithm.base == similarity.PEARSON:
        rows = cooccurrence.user_item_ratings(mine, by=())
    else:
        rows = cooccurrence.user_items(mine, by=()).withColumn("rating", F.lit(None).cast("double"))
    rows = rows.persist()
    try:
        parts = [row["part"] for row in rows.select(ROWS.bucket().alias("part")).distinct().collect()]
        seen = _of(batches.read(spark, _folder(root), ROWS, parts), algorithm)
        fresh = deltas.fresh_rows(rows, seen).persist()
        try:
            outputs = {
                ROWS: fresh,
                SUMS: deltas.added_pairs(fresh, seen),
                ITEMS: deltas.added_items(fresh),
            }
            names = {"channel_id": F.lit(algorithm.channel_id), "algo_id": F.lit(algorithm.algo_id)}
            batches.write(
                {table: frame.withColumns(names) for table, frame in outputs.items()},
                _folder(root),
                _source(algorithm),
                batch,
            )
        finally:
            fresh.unpersist()
    finally:
        rows.unpersist()
    return True


def similarities(spark: SparkSession, root: str, algorithm: Algorithm) -> DataFrame:
    """``(item_id, other_id, score)`` with ``item_id < other_id``, as a full run gives them."""
    stored = _of(batches.read(spark, _folder(root), SUMS), algorithm)
    pairs = deltas.summed(stored, ("item_id", "other_id"), deltas.ADDED)
    if algorithm.base == similarity.PEARSON:
        score = scores.pearson(*[F.col(name) for name in deltas.ADDED])
        return pairs.select("item_id", "other_id", score.alias("score"))
    counts = _of(batches.read(spark, _folder(root), ITEMS), algorithm)
    table = deltas.pair_table(pairs, deltas.summed(counts, ("item_id",), ("users",)))
    return table.select("item_id", "other_id", similarity.count_score(algorithm.base).alias("score"))


def compact(spark: SparkSession, root: str) -> int | None:
    """Add the batches up that came since the last time, beside updates."""
    return batches.compact(spark, _folder(root), TABLES)


def clean(spark: SparkSession, root: str, older_than_ms: int = 86_400_000) -> int:
    return batches.clean(spark, _folder(root), TABLES, older_than_ms)
