"""Content attributes: filling missing values, and items similar to a given one.

Attribute similarity is answered for one item at a time, by a scan of the channel: with
numeric attributes any two items have some similarity, so a table of all pairs would grow
with the square of the items.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators import ranking, skew
from kindred.operators.cooccurrence import BY_CHANNEL
from kindred.operators.items import NUMERIC, Attributes

# Policies for missing numeric values.
ZERO, MEAN, MEDIAN = "zero", "mean", "median"

# The approximate quantiles around the middle are off by at most 1/ACCURACY of the rows, so
# the exact middle lies between them.
ACCURACY = 10_000
BRACKET = (0.499, 0.501)


def numeric_keys(attributes: Attributes) -> list[str]:
    return [key for key, (_, kind) in attributes.items() if kind == NUMERIC]


def _beside(rows: DataFrame, summary: DataFrame, by: Sequence[str]) -> DataFrame:
    """Put a summary with one row per group (or one row in all) beside each row."""
    if by:
        return rows.join(skew.measured(summary, by), list(by), "left")
    names = summary.columns
    # One row: a scalar subquery instead of a join.
    only = summary.select(F.struct(*names).alias("only")).scalar()
    values = rows.withColumn("only", only)
    return values.withColumns({n: F.col(f"only.{n}") for n in names}).drop("only")


def medians(
    items: DataFrame, columns: Sequence[str], by: Sequence[str] = BY_CHANNEL
) -> DataFrame:
    """Exact medians per channel, one column per attribute.

    Approximate quantiles first bracket the middle; only the distinct values inside the
    bracket (about 0.2 % of the rows) are then ranked, with everything below counted.
    """
    melted = items.select(
        *by,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("attribute"), F.col(name).alias("value"))
                    for name in columns
                ]
            )
        ),
    ).where(F.col("value").isNotNull())
    group = [*by, "attribute"]
    quantiles = F.percentile_approx("value", F.array(*map(F.lit, BRACKET)), ACCURACY)
    brackets = melted.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), quantiles.alias("bracket")
    )
    low, high = F.col("bracket")[0], F.col("bracket")[1]
    counts = (
        melted.join(skew.measured(brackets, group), group)
        .where(F.col("value") <= high)
        .groupBy(*group, "n", F.when(F.col("value") >= low, F.col("value")).alias("value"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    upto = F.sum("rows").over(
        Window.partitionBy(*group)
        .orderBy(F.col("value").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = counts.withColumn("upto", upto)

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("upto") > position, F.col("value")))

    middles = ranked.groupBy(*group).agg(
        ((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("median")
    )
    return middles.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("attribute") == name, F.col("median"))).alias(name)
            for name in columns
        ]
    )


def impute(
    items: DataFrame, attributes: Attributes, policy: str, by: Sequence[str] = BY_CHANNEL
) -> DataFrame:
    """Fill missing numeric values with zero, or their channel's mean or median."""
    columns = numeric_keys(attributes)
    if policy == ZERO:
        return items.fillna(0.0, subset=columns)
    if policy == MEAN:
        fillers = items.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns])
    elif policy == MEDIAN:
        fillers = medians(items, columns, by)
    else:
        raise ValueError(f"unknown policy {policy!r}; known: {[ZERO, MEAN, MEDIAN]}")
    renamed = fillers.withColumnsRenamed({c: f"filler_{c}" for c in columns})
    filled = {c: F.coalesce(F.col(c), F.col(f"filler_{c}")) for c in columns}
    return _beside(items, renamed, by).withColumns(filled).drop(*renamed.drop(*by).columns)


def scale(
    items: DataFrame, columns: Sequence[str], by: Sequence[str] = BY_CHANNEL
) -> DataFrame:
    """Numeric values moved to [0, 1] per channel; a constant attribute becomes 0."""
    bounds = items.groupBy(*by).agg(
        *[F.min(c).alias(f"min_{c}") for c in columns],
        *[F.max(c).alias(f"max_{c}") for c in columns],
    )

    def scaled(name: str) -> Column:
        low, high = F.col(f"min_{name}"), F.col(f"max_{name}")
        return F.when(high > low, (F.col(name) - low) / (high - low)).otherwise(0.0)

    return (
        _beside(items, bounds, by)
        .withColumns({c: scaled(c) for c in columns})
        .drop(*bounds.drop(*by).columns)
    )


def vectors(items: DataFrame, attributes: Attributes, policy: str) -> DataFrame:
    """Prepared attributes of the items of one channel: ``numbers`` filled and scaled,
    ``shared`` the categorical values an item can share with another, and their ``norm``.

    Every value of a categorical attribute is a dimension of its own, so two items share it or
    not.
    """
    numeric = numeric_keys(attributes)
    categorical = [key for key in attributes if key not in numeric]
    rows = scale(impute(items, attributes, policy, by=()), numeric, by=())
    norm = F.sqrt(
        sum((F.col(c) * F.col(c) for c in numeric), F.lit(0.0))
        + sum((F.col(c).isNotNull().cast("int") for c in categorical), F.lit(0))
    )
    numbers = F.array(*[F.col(c) for c in numeric]).cast("array<double>")
    values = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in categorical]
    shared = F.array_compact(F.array(*values).cast("array<string>"))
    return rows.select(
        "item_id", numbers.alias("numbers"), shared.alias("shared"), norm.alias("norm")
    )


def similar_by_vectors(
    prepared: DataFrame, item: int, num: int | None = ranking.SIMILAR_ITEMS_DEFAULT
) -> DataFrame:
    """The items with the highest cosine with one item's vector, in thousandths: one scan.

    The given item's vector is one row, so a scalar subquery brings it to the scan.
    """
    given = (
        prepared.where(F.col("item_id") == item)
        .limit(1)
        .select(F.struct("numbers", "shared", "norm").alias("given"))
        .scalar()
    )
    products = F.zip_with("numbers", "given.numbers", lambda x, y: x * y)
    dot = F.aggregate(products, F.lit(0.0), lambda total, x: total + x) + F.size(
        F.array_intersect("shared", "given.shared")
    )
    cosine = F.coalesce(F.try_divide(dot, F.col("norm") * F.col("given.norm")), F.lit(0.0))
    return (
        prepared.where(F.col("item_id") != item)
        .withColumn("given", given)
        .where(F.col("given").isNotNull())
        .select(
            F.lit(item).cast("bigint").alias("item_id"),
            F.col("item_id").alias("other_id"),
            F.round(cosine * 1000).cast("bigint").alias("score"),
        )
        .orderBy(F.col("score").desc(), "other_id")
        .limit(ranking.result_size(num, ranking.SIMILAR_ITEMS_DEFAULT))
    )


def similar_by_content(
    items: DataFrame,
    attributes: Attributes,
    policy: str,
    item: int,
    num: int = ranking.SIMILAR_ITEMS_DEFAULT,
) -> DataFrame:
    """The same from items that are not prepared; they are those of one channel."""
    return similar_by_vectors(vectors(items, attributes, policy), item, num)
