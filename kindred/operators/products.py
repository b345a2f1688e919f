"""The k largest inner products of every user with items, without all users times all items.

Items are numbered by falling length of their vectors and cut into blocks. By Cauchy and Schwarz a
user's product with an item is at most the product of both lengths, so once the k-th best product
found is above the user's length times the largest length of a block, neither that block nor any
later one can change the answer, and the user is done. Users go through the blocks in rounds of
``ROUND_ITEMS`` items, and only users that are not done enter the next one. Inside a round they take
ever more blocks at once, up to ``STEP_ITEMS`` items, and only those with a product that reaches their
k-th best change. Without any fall in length this is all users times all items, in matrix products.

A round is a map over users with its items broadcast, joined with the users' seen items among these
alone; users are written once a round. The result is that of scoring all items.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators import skew
from kindred.session import work_folder

# The map goes to executors by value; they need numpy and pyarrow, but no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ITEMS, STEP_ITEMS, ROUND_ITEMS = 2048, 2048, 32768
# Room for rounding in the product of two lengths.
SLACK = 1 + 1e-9
STATE = (
    "user_id bigint, vector array<double>, length double, scores array<double>, ids array<bigint>, "
    "blocks bigint, done boolean"
)


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Rows as a table in the shared work folder, so that a lost executor costs a read."""
    path = work_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _length(vector: str):
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x))


def _with_length(rows: DataFrame) -> DataFrame:
    """Finite vectors that are not zero, in doubles, with their lengths."""
    wide = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    measured = wide.withColumn("length", _length("vector"))
    return measured.where((F.col("length") > 0) & (F.col("length") < float("inf")))


def numbered(ordered: DataFrame) -> DataFrame:
    """Sorted rows with ``number``, their place from 0.

    Sorted partitions are numbered inside and moved apart by the counts of those before.
    """
    columns = ordered.columns
    placed = stored(
        ordered.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "numbered"
    )
    counts = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    number = F.col("offset") + F.col("row") - F.col("first")
    return placed.join(offsets, "part").select(*columns, number.alias("number"))


def by_length(items: DataFrame) -> DataFrame:
    """Items numbered by falling length, then id."""
    return numbered(_with_length(items).orderBy(F.col("length").desc(), "item_id"))


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def _parts(lists: pa.Array) -> list[np.ndarray]:
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return np.split(lists.flatten().to_numpy(zero_copy_only=False), ends[:-1])


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *(part.size for part in parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts), kind))


def _round(block: np.ndarray, ids: np.ndarray, lengths: np.ndarray, after: float, first: bool, k: int, size: int):
    """A map over users: their state after the blocks of a round, whose items are given."""

    def best_of(scores: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if scores.size > k:
            bar = np.partition(scores, -k)[-k]
            near = scores >= bar
            scores, found = scores[near], found[near]
        order = np.lexsort((found, -scores))[:k]
        return scores[order], found[order]

    def work(rows: pa.RecordBatch) -> pa.RecordBatch:
        vectors, own = _matrix(rows["vector"]), _numbers(rows["length"])
        scores, found = _parts(rows["scores"]), _parts(rows["ids"])
        bars = np.array([s[-1] if s.size == k else -np.inf for s in scores])
        seen = _parts(rows["seen"])
        seen_by, seen = np.repeat(np.arange(len(seen)), [part.size for part in seen]), np.concatenate(seen)
        looked = _numbers(rows["blocks"]).copy()
        # Few blocks at first, while bars are low.
        start, blocks, most = 0, 1 if first else STEP_ITEMS, max(1, STEP_ITEMS // size)
        while start < len(ids):
            end = min(start + min(blocks, most) * size, len(ids))
            reach = bars[:, None] <= own[:, None] * lengths[start:end:size] * SLACK
            active = np.flatnonzero(reach[:, 0])
            if not active.size:
                break
            looked += reach.sum(1)
            products = vectors[active] @ block[start:end].T
            place = np.full(len(own), -1)
            place[active] = np.arange(active.size)
            here = (seen >= start) & (seen < end) & (place[seen_by] >= 0)
            products[place[seen_by[here]], seen[here] - start] = -np.inf
            # Also finite, as a user without k items has no bar.
            reached = (products >= bars[active, None]).any(1)
            for row in np.flatnonzero(reached):
                at = active[row]
                better = np.flatnonzero((products[row] >= bars[at]) & (products[row] > -np.inf))
                if better.size:
                    scores[at], found[at] = best_of(
                        np.append(scores[at], products[row, better]), np.append(found[at], ids[start:end][better])
                    )
                    if scores[at].size == k:
                        bars[at] = scores[at][-1]
            start, blocks = end, 2 * blocks
        columns = {
            **{name: rows[name] for name in ("user_id", "vector", "length")},
            "scores": _lists(scores, pa.float64()),
            "ids": _lists(found, pa.int64()),
            "blocks": pa.array(looked, pa.int64()),
            "done": pa.array(bars > own * after * SLACK),
        }
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                yield work(batch.slice(start, 512))

    return run


def largest_products(
    users: DataFrame,
    items: DataFrame,
    seen: DataFrame,
    k: int,
    block_items: int = BLOCK_ITEMS,
) -> tuple[DataFrame, DataFrame]:
    """(best, looked): each user's k items with the largest inner product that they have not seen.

    ``users`` has user_id and vector, ``items`` item_id and vector, ``seen`` user_id and item_id.
    ``best`` has user_id, item_id, score and rank; ties go to the smaller item. ``looked`` says how
    many of all ``n_blocks`` blocks each user met. NULL, zero and infinite vectors take no part.
    """
    spark = users.sparkSession
    placed = stored(by_length(items), "by-length")
    total = placed.count()
    n_blocks = -(-total // block_items)
    known = skew.measured(placed.select("item_id", "number"), ["item_id"])
    looked_at = stored(
        seen.select("user_id", "item_id").distinct().join(known, "item_id").select("user_id", "number").sort("number"), "seen"
    )
    none = F.array()
    fresh = _with_length(users).select(
        "user_id", "vector", "length", none.cast("array<double>").alias("scores"),
        none.cast("array<bigint>").alias("ids"), F.lit(0).cast("bigint").alias("blocks"), F.lit(False).alias("done"),
    )
    # Users are little data and much work.
    state = stored(skew.spread(fresh, ["user_id"]), "users")
    finished, first = [], 0
    per_round = max(1, ROUND_ITEMS // block_items) * block_items
    while first < total:
        end = min(first + per_round, total)
        rows = placed.where(F.col("number").between(first, end)).orderBy("number").toArrow()
        # The first item after the round says how long those to come are at most.
        inside, after = rows.slice(0, end - first), rows.slice(end - first)
        shared = spark.sparkContext.broadcast(
            (_matrix(inside["vector"]), _numbers(inside["item_id"]), _numbers(inside["length"]))
        )
        limit = after["length"][0].as_py() if len(after) else 0.0
        met = (
            looked_at.where(F.col("number").between(first, end - 1))
            .groupBy("user_id")
            .agg(F.collect_list(F.col("number") - first).alias("seen"))
        )

        def run(batches, shared=shared, limit=limit, start=first):
            return _round(*shared.value, limit, start == 0, k, block_items)(batches)

        state = stored(state.join(met, "user_id", "left").mapInArrow(run, STATE), "round")
        first = end
        if first < total:
            finished.append(state.where("done"))
            state = state.where("NOT done")
            if state.isEmpty():
                break
    for more in finished:
        state = state.unionByName(more)
    ranked = state.select("user_id", F.posexplode(F.arrays_zip("scores", "ids")).alias("place", "found"))
    best = ranked.select(
        "user_id", F.col("found.ids").alias("item_id"), F.col("found.scores").alias("score"),
        (F.col("place") + 1).cast("bigint").alias("rank"),
    )
    return best, state.select("user_id", "blocks", F.lit(n_blocks).cast("bigint").alias("n_blocks"))
