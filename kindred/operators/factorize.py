"""Matrix factorisation: predictions for the observed (user, item) pairs."""

from __future__ import annotations

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators import cooccurrence, filters, products
from kindred.session import work_folder

# The model's size and weights.
RANK = 10
ITERATIONS = 10
REGULARISATION = 0.01
IMPLICIT_ALPHA = 0.01

def dense_ids(rows: DataFrame, name: str) -> DataFrame:
    """``name`` and a dense number from 0 for each of its values.

    The model takes 32-bit ids. Values are numbered inside their partitions, and the counts of
    the partitions before, one row each, move them apart. The values are written first, so that
    both steps see the same partitions.
    """
    spark = rows.sparkSession
    path = work_folder(spark, f"ids-{name}")
    distinct = rows.select(name).distinct()
    placed = distinct.withColumns(
        {"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}
    )
    placed.write.parquet(path)
    stored = spark.read.schema(placed.schema).parquet(path)
    counts = stored.groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    number = F.col("offset") + F.col("row") - F.col("first")
    return stored.join(offsets, "part").select(
        name, number.cast("int").alias(name.replace("_id", "_number"))
    )


def ratings(interactions: DataFrame) -> DataFrame:
    """Distinct (user, item, rating). The rows must be of one channel."""
    rows = cooccurrence.user_item_ratings(filters.ratings_only(interactions), by=())
    return rows.select("user_id", "item_id", F.col("rating").cast("float").alias("rating"))


def fit(rows: DataFrame, implicit: bool = False, seed: int = 0) -> ALSModel:
    # One block per core of the cluster, and not fewer than the library's default.
    blocks = max(10, rows.sparkSession.sparkContext.defaultParallelism)
    als = ALS(
        userCol="user_number",
        itemCol="item_number",
        ratingCol="rating",
        rank=RANK,
        maxIter=ITERATIONS,
        regParam=REGULARISATION,
        alpha=IMPLICIT_ALPHA if implicit else 1.0,
        implicitPrefs=implicit,
        numUserBlocks=blocks,
        numItemBlocks=blocks,
        seed=seed,
    )
    return als.fit(rows)


def _numbered(interactions: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Ratings with dense numbers for users and items, and the numbers themselves."""
    rows, numbers = ratings(interactions), {}
    for name in ("user_id", "item_id"):
        numbers[name] = dense_ids(rows, name)
        rows = rows.join(numbers[name], name)
    return rows, numbers


def predictions(interactions: DataFrame, implicit: bool = False, seed: int = 0) -> DataFrame:
    """``(user_id, item_id, score)`` for every observed pair."""
    rows, _ = _numbered(interactions)
    observed = rows.select("user_id", "item_id", "user_number", "item_number").distinct()
    scored = fit(rows, implicit, seed).transform(observed)
    return scored.select(
        "user_id",
        "item_id",
        F.col("prediction").cast("double").alias("score"),
    )


def _vectors(factors: DataFrame, numbers: DataFrame, name: str) -> DataFrame:
    ids = numbers.select(name, F.col(name.replace("_id", "_number")).alias("id"))
    return factors.join(ids, "id").select(name, F.col("features").alias("vector"))


def unseen(
    interactions: DataFrame, num: int, implicit: bool = False, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(best, looked): the ``num`` items with the highest predictions that each user has not rated,
    and how many blocks of items had to be looked at (see ``products``)."""
    rows, numbers = _numbered(interactions)
    model = fit(rows, implicit, seed)
    return products.largest_products(
        _vectors(model.userFactors, numbers["user_id"], "user_id"),
        _vectors(model.itemFactors, numbers["item_id"], "item_id"),
        rows.select("user_id", "item_id"),
        num,
    )
