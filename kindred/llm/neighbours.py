"""Nearest neighbours by cosine: a block matrix join with int8 tiles and error bounds.

Vectors are packed into blocks that hold unit vectors as int8 codes, the error of that rounding,
and the original numbers. Query blocks lie in parts and candidate blocks in stripes; a cell is one of
each, the join key is the cell, and one tile is (query block, candidate block). In a tile the
product of the codes gives each cosine up to a bound that follows from both rounding errors. Pairs
whose upper bound is below the k-th best lower bound, or below what earlier tiles reached, can't be
among the nearest; the others are recomputed in double precision from the original numbers, and a
heap per query merges what the tiles of a task find. Spark ranks the heaps of all tasks. The result
is exact.

Blocks are repeated, queries once per stripe and candidates once per part; there are as many parts
and stripes as move the fewest rows for that number of cells. Neither side is ever broadcast: Spark
measures queries before they are packed and repeated, so its estimate of them is far too low. A vector
that many rows share is no key, so it spreads like any other.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERY_BLOCK, CANDIDATE_BLOCK = 512, 2048
BLOCK = "dim int, ids binary, vectors binary, codes binary, steps binary, errors binary"
FOUND = "query_id bigint, vec_id bigint, score double"
SLACK = 1e-9  # over the rounding of the bounds themselves


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and vector of the rows that take part, in double precision."""
    rows = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.col(vector_column).cast("array<double>").alias("vector"),
    )

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    return rows.filter(
        F.col("vec_id").isNotNull()
        & F.forall("vector", finite)
        & F.exists("vector", lambda x: x != 0)
    )


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest number first, against underflow."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def pack(ids: np.ndarray, vectors: np.ndarray) -> dict:
    """A block: int8 codes, their step per vector, and the length of what rounding lost."""
    units = unit(vectors)
    steps = np.abs(units).max(1) / 127
    codes = np.rint(units / steps[:, None]).astype(np.int8)
    errors = np.sqrt(((units - codes * steps[:, None]) ** 2).sum(1))
    return {
        "dim": vectors.shape[1],
        "ids": ids.astype(np.int64).tobytes(),
        "vectors": vectors.astype(np.float64).tobytes(),
        "codes": codes.tobytes(),
        "steps": steps.tobytes(),
        "errors": errors.tobytes(),
    }


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Blocks of up to ``size`` vectors of the same dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[int, np.ndarray]]] = {}

        def out(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            ids = np.array([number for number, _ in rows], np.int64)
            block = pack(ids, np.stack([vector for _, vector in rows]))
            return pa.RecordBatch.from_pylist(
                [block],
                pa.schema(
                    [("dim", pa.int32())]
                    + [(n, pa.binary()) for n in ("ids", "vectors", "codes", "steps", "errors")]
                ),
            )

        for batch in batches:
            lists = batch["vector"]
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            for number, vector in zip(batch["vec_id"].to_pylist(), np.split(flat, ends[:-1])):
                rows = waiting.setdefault(len(vector), [])
                rows.append((number, vector))
                if len(rows) == size:
                    yield out(waiting.pop(len(vector)))
        for rows in waiting.values():
            yield out(rows)

    return vectors.mapInArrow(run, BLOCK)


class Block:
    """A packed block read back."""

    def __init__(self, row: dict, side: str):
        read = lambda name, kind: np.frombuffer(row[f"{side}_{name}"], kind)
        self.ids = read("ids", np.int64)
        shape = (len(self.ids), row["dim"])
        self.vectors = read("vectors", np.float64).reshape(shape)
        # Sums of products of codes stay exact in single precision up to 1,040 dimensions.
        exact = np.float32 if row["dim"] <= 1040 else np.float64
        self.codes = read("codes", np.int8).reshape(shape).astype(exact)
        self.steps, self.errors = read("steps", np.float64), read("errors", np.float64)


def tile(queries: Block, candidates: Block, least: np.ndarray, k: int):
    """(query rows, candidate rows) that may be among the k nearest, given the scores already
    reached."""
    near = (queries.codes @ candidates.codes.T) * queries.steps[:, None] * candidates.steps
    rounded = 1 + candidates.errors
    bound = queries.errors[:, None] * rounded + (1 + queries.errors[:, None]) * candidates.errors
    bound += queries.errors[:, None] * candidates.errors + SLACK
    own = queries.ids[:, None] == candidates.ids
    low = np.where(own, -np.inf, near - bound)
    if low.shape[1] > k:
        kth = np.partition(low, -k, axis=1)[:, -k]
    else:
        kth = np.full(len(low), -np.inf)
    keep = (near + bound >= np.maximum(kth, least - SLACK)[:, None]) & ~own
    return np.nonzero(keep)


def exact_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosines of rows, each computed alone, so that equal vectors get equal scores."""
    a = left / np.abs(left).max(1, keepdims=True)
    b = right / np.abs(right).max(1, keepdims=True)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def search_tiles(k: int):
    """Turns tiles into the nearest of each query among them, heap by heap."""

    def emit(heaps: dict[int, list]) -> pa.RecordBatch:
        rows = [(q, -n, s) for q, heap in heaps.items() for s, n in heap]
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
             pa.array(columns[2], pa.float64())],
            names=["query_id", "vec_id", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, heaps, queries = None, {}, None
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch[name][at].as_py() for name in batch.schema.names}
                if row["q_ids"] != current:  # heaps live as long as their query block
                    if heaps:
                        yield emit(heaps)
                    current, queries = row["q_ids"], Block(row, "q")
                    heaps = {number: [] for number in queries.ids.tolist()}
                candidates = Block(row, "c")
                full = [heaps[number] for number in queries.ids.tolist()]
                least = np.array([heap[0][0] if len(heap) == k else -np.inf for heap in full])
                left, right = tile(queries, candidates, least, k)
                step = max(1, (1 << 22) // max(1, row["dim"]))
                for begin in range(0, len(left), step):
                    q, c = left[begin : begin + step], right[begin : begin + step]
                    scores = exact_scores(queries.vectors[q], candidates.vectors[c])
                    for place, number, score in zip(
                        q.tolist(), candidates.ids[c].tolist(), scores.tolist()
                    ):
                        heap, entry = full[place], (score, -number)
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
        if heaps:
            yield emit(heaps)

    return run


def grid_parts(cells: int, queries: int, candidates: int) -> int:
    """Parts of the queries for which so many cells repeat the fewest rows of both sides."""
    return max(1, round(math.sqrt(cells * queries / max(1, candidates))))


def nearest(
    vectors: DataFrame,
    every: int = 50,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of every query, nearest first.

    Queries are the rows whose id ``every`` divides. Ties go to the smaller id. Vectors that are
    NULL, empty, zero or hold NULL or non-finite numbers, and rows without an id, take no part;
    vectors of another dimension than the query's are no candidates. Rows that share an id are
    candidates of their own, but never of a query with that id, which is one query (its smallest
    vector). Fewer than k candidates are all returned; an empty table gives an empty result. Other
    columns are not read.
    """
    spark = vectors.sparkSession
    ready = usable(vectors, id_column, vector_column)
    is_asked = F.col("vec_id") % every == 0
    one = ready.filter(is_asked).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    ids = vectors.select(F.col(id_column).cast("long").alias("vec_id"))
    n_rows, n_asked = ids.agg(F.count("vec_id"), F.count_if(is_asked)).first()
    n_blocks = max(1, -(-n_asked // QUERY_BLOCK))
    n_tiles = n_blocks * max(1, -(-n_rows // CANDIDATE_BLOCK))
    cells = min(int(spark.conf.get("spark.sql.shuffle.partitions")), n_tiles)
    parts = min(n_blocks, grid_parts(cells, n_asked, n_rows))
    stripes = -(-cells // parts)
    # Query blocks are even in size, one or two to a partition.
    part = F.pmod(F.spark_partition_id(), F.lit(parts))
    stripe = F.pmod(F.xxhash64("ids"), F.lit(stripes)).cast("int")

    def every_one(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def named(frame: DataFrame, side: str, **place: Column) -> DataFrame:
        columns = [F.col(n).alias(f"{side}_{n}") for n in frame.columns if n != "dim"]
        return frame.select("dim", *columns, *[at.alias(name) for name, at in place.items()])

    candidates = named(blocks(ready, CANDIDATE_BLOCK), "c", stripe=stripe, part=every_one(parts))
    queries = named(blocks(one.repartition(n_blocks), QUERY_BLOCK), "q", part=part, stripe=every_one(stripes))
    tiles = queries.hint("merge").join(candidates, ["part", "stripe", "dim"]).drop("part", "stripe")
    found = tiles.mapInArrow(search_tiles(k), FOUND)
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
