"""Item-to-item similarity by algorithm name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import scores
from kindred.operators import cooccurrence, filters
from kindred.operators.cooccurrence import BY_CHANNEL

# Algorithm base names.
COUNT_SCORES: dict[str, Callable[..., Column]] = {
    "cooccurrence": scores.cooccurrence,
    "jaccard": scores.jaccard,
    "cosine": scores.cosine,
    "loglikelihood": scores.loglikelihood,
}
PEARSON = "pearson"
NEEDS_TOTAL = "loglikelihood"
FACTORISATIONS = ("als", "alsimplicit")
CONTENT = "contentbased"
BASE_NAMES = (*COUNT_SCORES, PEARSON, *FACTORISATIONS, CONTENT)


def count_score(base: str) -> Column:
    return COUNT_SCORES[base](*[F.col(name) for name in ("n12", "n1", "n2", "total")])


def similarity(
    interactions: DataFrame,
    base: str,
    actions: Sequence[str] | None = None,
    by: Sequence[str] = BY_CHANNEL,
) -> DataFrame:
    """``(item_id, other_id, score)`` with ``item_id < other_id`` per channel."""
    if base not in (*COUNT_SCORES, PEARSON):
        known = [*COUNT_SCORES, PEARSON]
        raise ValueError(f"{base!r} is not an item similarity; known: {known}")
    rows = filters.for_algorithm(interactions, base, actions)
    if base == PEARSON:
        sums = cooccurrence.co_ratings(rows, by)
        names = ("n", "sum_x", "sum_y", "sum_xx", "sum_yy", "sum_xy")
        score = scores.pearson(*[F.col(name) for name in names])
        return sums.select(*by, "item_id", "other_id", score.alias("score"))
    return count_similarities(rows, [base], by=by).withColumnRenamed(base, "score")


def count_similarities(
    interactions: DataFrame,
    bases: Sequence[str] = tuple(COUNT_SCORES),
    by: Sequence[str] = BY_CHANNEL,
) -> DataFrame:
    """Several count-based scores from one pair table, one column each."""
    if list(bases) == ["cooccurrence"]:
        pairs = cooccurrence.pair_counts(cooccurrence.user_items(interactions, by), by)
        return pairs.withColumnRenamed("n12", "cooccurrence")
    table = cooccurrence.pair_table(interactions, by, total=NEEDS_TOTAL in bases)
    return table.select(
        *by, "item_id", "other_id", *[count_score(base).alias(base) for base in bases]
    )


def symmetric(pairs: DataFrame, values: Sequence[str] = ("score",)) -> DataFrame:
    """Every pair in both directions, from one pass over the pairs."""
    others = [c for c in pairs.columns if c not in ("item_id", "other_id", *values)]
    ends = F.explode(
        F.array(
            F.struct(F.col("item_id").alias("a"), F.col("other_id").alias("b")),
            F.struct(F.col("other_id").alias("a"), F.col("item_id").alias("b")),
        )
    )
    return pairs.withColumn("ends", ends).select(
        *others, F.col("ends.a").alias("item_id"), F.col("ends.b").alias("other_id"), *values
    )
