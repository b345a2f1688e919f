"""Similarity scores as Column expressions.

``n12`` is the number of users with both items, ``n1`` and ``n2`` the number with each, and
``total`` the number of distinct (user, item) rows. Scores other than co-occurrence are
thousandths, rounded half away from zero. The formulas are the definitions results have to
match: cosine divides by the sum of the roots, and the fourth log-likelihood cell is ``total``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def thousandths(value: Column) -> Column:
    return F.round(value * 1000).cast("bigint")


def cooccurrence(n12: Column, n1: Column, n2: Column, total: Column) -> Column:
    return n12.cast("bigint")


def jaccard(n12: Column, n1: Column, n2: Column, total: Column) -> Column:
    return thousandths(n12 / (n1 + n2 - n12))


def cosine(n12: Column, n1: Column, n2: Column, total: Column) -> Column:
    return thousandths(n12 / (F.sqrt(n1) + F.sqrt(n2)))


def _x_log_x(x: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.log(x))


def _entropy(*counts: Column) -> Column:
    whole, parts = counts[0], _x_log_x(counts[0])
    for count in counts[1:]:
        whole, parts = whole + count, parts + _x_log_x(count)
    return _x_log_x(whole) - parts


def loglikelihood(n12: Column, n1: Column, n2: Column, total: Column) -> Column:
    without_other, without_item = n1 - n12, n2 - n12
    rows = _entropy(n2, without_other + total)
    cols = _entropy(n1, without_item + total)
    cells = _entropy(n12, without_item, without_other, total)
    ratio = thousandths(F.lit(2) * (rows + cols - cells))
    return F.when((n12 <= 0) | (rows + cols < cells), F.lit(0).cast("bigint")).otherwise(ratio)


def pearson(
    n: Column, sum_x: Column, sum_y: Column, sum_xx: Column, sum_yy: Column, sum_xy: Column
) -> Column:
    """Correlation of co-ratings moved from [-1, 1] to [0, 1000]; 0 without variance."""
    spread = (sum_xx - sum_x * sum_x / n) * (sum_yy - sum_y * sum_y / n)
    # Rounding can push a zero variance slightly below zero.
    scale = F.sqrt(F.greatest(spread, F.lit(0.0)))
    centred = F.try_divide(sum_xy - sum_x * sum_y / n, scale)
    return F.when(scale == 0, F.lit(0).cast("bigint")).otherwise(thousandths((1 + centred) / 2))
