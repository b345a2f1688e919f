"""The k most similar items of every item by attributes, without a table of all pairs.

Divided by its norm an item is a point, and a cosine falls with the square of the distance of two
points. Items with like attributes are put in blocks: in the order of their categorical values, then
along a curve through their numbers (Morton order), which keeps near points together. A block is
described by the box around its points, the categorical values found in it, the least and the most
of them in one item, and the range of its norms. From that follows, for any item, an upper bound of
its cosine with all items of the block: by the distance from the box, and by as many common values as
inverted lists (value to blocks) count. Where all items of a block hold the same values, the box's
farthest corner gives a lower bound, too.

Every item first meets the items of its own block; the k-th best score found there is its bar, or
what the lower bound of a block with more than k items promises. Then it goes to the blocks whose
bound reaches the bar, and only to these; whole blocks are compared before their items are. At the
end the best k of all that was met are kept: the same as of all pairs, as scores can't be above their
bounds.

There are at most ``MOST_BLOCKS`` blocks, however many items; their descriptions are broadcast. Beyond
``FEW_BLOCKS`` blocks these first grow to ``BLOCK_ITEMS`` items, so that most of what an item has to
meet lies in its own block. A block that very many items go to is met in parts of ``PART_ITEMS`` of
them. Only item and block numbers, vectors and at most k results per item and block met are shuffled.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators import products, ranking, skew

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ITEMS, FEW_BLOCKS, MOST_BLOCKS, PART_ITEMS = 1024, 256, 1 << 16, 2048
CURVE_BITS, LEVEL_BITS = 62, 16
# Room for rounding in bounds of cosines.
SLACK = 1e-9
VECTOR = "item_id bigint, numbers array<double>, shared array<string>, norm double"
FOUND = "item_id bigint, other_id bigint, score bigint"
# An item, the best of its own block, and the other blocks to meet.
OWN = f"{VECTOR}, ids array<bigint>, scores array<bigint>, to array<bigint>"
SUMMARY = (
    "block bigint, low array<double>, high array<double>, common array<string>, fewest int, most int, "
    "alike boolean, inverse_low double, inverse_high double, square_low double, square_high double, ids array<bigint>"
)


class Vectors:
    """Rows of prepared attributes as arrays: numbers, norms, and the items that hold each value."""

    def __init__(self, table: pa.Table):
        self.ids = table["item_id"].to_numpy()
        self.norms = table["norm"].to_numpy()
        rows = table["numbers"].to_pylist()
        self.numbers = np.array(rows, float).reshape(len(rows), -1)
        self.shared = table["shared"].to_pylist()
        self.holders: dict[str, list[int]] = defaultdict(list)
        for place, values in enumerate(self.shared):
            for value in values:
                self.holders[value].append(place)

    def scores(self, queries: Vectors) -> np.ndarray:
        """Cosines with other rows in thousandths, rounded; 0 where a norm is."""
        dots = queries.numbers @ self.numbers.T
        for value, places in queries.holders.items():
            if value in self.holders:
                dots[np.ix_(places, self.holders[value])] += 1
        norms = queries.norms[:, None] * self.norms
        cosines = np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)
        return np.floor(cosines * 1000 + 0.5).astype(np.int64)

    def boxes(self) -> dict[str, np.ndarray]:
        """Every row as a box of its own: numbers and 1 over norms, square of the length, values held."""
        inverse = np.divide(1.0, self.norms, out=np.zeros_like(self.norms), where=self.norms > 0)
        points, held = self.numbers * inverse[:, None], np.array([len(v) for v in self.shared])
        square = (points**2).sum(1) + held * inverse**2
        return {
            "low": points, "high": points, "fewest": held, "most": held, "inverse_low": inverse,
            "inverse_high": inverse, "square_low": square, "square_high": square,
        }


def _best(queries: Vectors, members: Vectors, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of members found for each query, and their ids and scores, one query after the other:
    the k best but itself; equal scores go by the smaller id."""
    by_id = np.argsort(members.ids, kind="stable")
    ids, number = members.ids[by_id], members.ids.size
    scores = members.scores(queries)[:, by_id]
    # Score and id as one number, smaller is better.
    order = np.arange(number) - scores * number
    own = ids == queries.ids[:, None]
    order[own] = np.iinfo(np.int64).max
    size = min(k, number)
    places = np.argpartition(order, size - 1, axis=1)[:, :size] if size else np.zeros((len(order), 0), np.int64)
    sort = np.argsort(np.take_along_axis(order, places, 1), axis=1)
    places = np.take_along_axis(places, sort, 1)
    others = ~np.take_along_axis(own, places, 1)
    return others.sum(1), ids[places][others], np.take_along_axis(scores, places, 1)[others]


def _curve(numbers: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Places of points along a curve: the bits of all their numbers, the highest ones first."""
    used = numbers[:, :CURVE_BITS]
    place = np.zeros(len(numbers), np.int64)
    bits = min(LEVEL_BITS, CURVE_BITS // max(1, used.shape[1]))
    points = np.divide(used, norms[:, None], out=np.zeros_like(used), where=norms[:, None] > 0)
    levels = np.clip((points + 1) * (1 << (bits - 1)), 0, (1 << bits) - 1).astype(np.int64)
    for bit in reversed(range(bits)):
        for level in levels.T:
            place = (place << 1) | ((level >> bit) & 1)
    return place


def in_blocks(prepared: DataFrame, block_items: int) -> DataFrame:
    """Prepared items with ``block``: like ones together, as many in a block as given."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = np.array(batch["numbers"].to_pylist(), float).reshape(batch.num_rows, -1)
                place = _curve(rows, batch["norm"].to_numpy(zero_copy_only=False))
                yield batch.append_column("place", pa.array(place, pa.int64()))

    items = prepared.select("item_id", "numbers", F.sort_array("shared").alias("shared"), "norm")
    placed = items.mapInArrow(near, f"{VECTOR}, place bigint")
    order = [F.concat_ws("\x01", "shared"), "place", "item_id"]
    numbered = products.numbered(placed.orderBy(*order))
    return numbered.withColumn("block", F.floor(F.col("number") / block_items)).drop("number", "place")


def _described(table: pa.Table, k: int) -> pa.Table:
    rows = Vectors(table)
    boxes = rows.boxes()
    told = {
        "block": table["block"][0].as_py(),
        "low": boxes["low"].min(0).tolist(),
        "high": boxes["high"].max(0).tolist(),
        "common": list(rows.holders),
        "fewest": int(boxes["fewest"].min()),
        "most": int(boxes["most"].max()),
        "alike": all(values == rows.shared[0] for values in rows.shared),
        "inverse_low": float(boxes["inverse_low"].min()),
        "inverse_high": float(boxes["inverse_high"].max()),
        "square_low": float(boxes["square_low"].min()),
        "square_high": float(boxes["square_high"].max()),
        "ids": np.sort(rows.ids)[: k + 1].tolist(),
    }
    doubles, texts, longs = pa.list_(pa.float64()), pa.list_(pa.string()), pa.list_(pa.int64())
    kinds = [pa.int64(), doubles, doubles, texts, pa.int32(), pa.int32(), pa.bool_(), *[pa.float64()] * 4, longs]
    return pa.Table.from_pylist([told], pa.schema(list(zip(told, kinds))))


class Blocks:
    """The descriptions of all blocks, and the bounds that follow from them."""

    def __init__(self, blocks: list[dict], k: int):
        names = [name.split()[0] for name in SUMMARY.split(", ")]
        told = {name: np.array([block[name] for block in blocks]) for name in names if name not in ("common", "ids")}
        self.number, self.alike = told.pop("block"), told.pop("alike")
        self.boxes = told | {name: told[name].astype(float).reshape(len(blocks), -1) for name in ("low", "high")}
        self.least = np.array([block["ids"][0] for block in blocks])
        # Among k + 1 items are k others of any item; the largest of their ids, if there are so many.
        self.full = np.array([len(block["ids"]) > k for block in blocks])
        self.last = np.array([block["ids"][-1] for block in blocks])
        self.place = {number: place for place, number in enumerate(self.number.tolist())}
        self.lists: dict[str, list[int]] = defaultdict(list)
        for place, block in enumerate(blocks):
            for value in block["common"]:
                self.lists[value].append(place)

    def common(self, values: Iterable[str]) -> np.ndarray:
        """How many of these values each block holds."""
        count = np.zeros(len(self.number))
        for value in values:
            count[self.lists.get(value, [])] += 1
        return count

    def _score(self, asked: dict, at: np.ndarray, common: np.ndarray, farthest: bool) -> np.ndarray:
        """Highest or, of blocks of like items, lowest scores of boxes (rows) with blocks (columns).

        A cosine is half of the squares of both lengths less that of the distance. Two items with p and
        q values, c of them common, and inverse norms v and w are apart by the distance of their
        numbers and (p - c)v² + (q - c)w² + c(v - w)² for their values.
        """
        box = {name: values[at] for name, values in self.boxes.items()}
        mine = {name: values[:, None] for name, values in asked.items()}
        near, far, held = ("high", "low", "most") if farthest else ("low", "high", "fewest")

        def gap(low, high, box_low, box_high) -> np.ndarray:
            after, before = box_low - high, low - box_high
            return -np.minimum(after, before) if farthest else np.maximum(0, np.maximum(after, before))

        apart = np.zeros(common.shape)
        for column in range(box["low"].shape[1]):
            ends = [one[name][..., column] for one in (mine, box) for name in ("low", "high")]
            apart += gap(*ends) ** 2
        common = np.minimum(common, np.minimum(box["most"], mine["most"]))
        for one in (mine, box):
            apart += np.maximum(0, one[held] - common) * one[f"inverse_{near}"] ** 2
        ends = [one[f"inverse_{name}"] for one in (mine, box) for name in ("low", "high")]
        apart += np.minimum(common, np.minimum(box["fewest"], mine["fewest"])) * gap(*ends) ** 2
        square = f"square_{far}"
        cosine = (mine[square] + box[square] - apart) / 2
        return np.floor((cosine + (-SLACK if farthest else SLACK)) * 1000 + 0.5).astype(np.int64)

    def to_meet(self, rows: Vectors, block: int, scores: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
        """The other blocks that each item of a block has to meet, by the score and id of its k-th best
        in its own block; a negative id if there is none."""
        here, known = self.place[block], ids >= 0
        others = np.delete(np.arange(len(self.number)), here)
        if known.all():
            whole = {name: values[[here]] for name, values in self.boxes.items()}
            bound = self._score(whole, others, self.common(rows.holders)[None, others], False)[0]
            others = others[bound >= scores.min()]
        found = []
        for start in range(0, len(rows.ids), 256):
            part = slice(start, start + 256)
            boxes = {name: values[part] for name, values in rows.boxes().items()}
            counts: dict[tuple, np.ndarray] = {}
            for values in map(tuple, rows.shared[part]):
                if values not in counts:
                    counts[values] = self.common(values)[others]
            common = np.stack([counts[tuple(values)] for values in rows.shared[part]])
            bar, last = scores[part].copy(), ids[part].copy()
            sure = np.flatnonzero(self.full[others] & self.alike[others])
            if sure.size:
                low = self._score(boxes, others[sure], common[:, sure], True)
                top = low.max(1)
                least = np.where(low == top[:, None], self.last[others[sure]], np.iinfo(np.int64).max).min(1)
                more = (last < 0) | (top > bar) | ((top == bar) & (least < last))
                bar, last = np.where(more, top, bar), np.where(more, least, last)
            bound = self._score(boxes, others, common, False)
            reached = (bound > bar[:, None]) | ((bound == bar[:, None]) & (self.least[others] <= last[:, None]))
            reached |= (last < 0)[:, None]
            found += [self.number[others[row]] for row in reached]
        return found


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(part) for part in parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts), pa.int64()))


def similar_items(
    prepared: DataFrame, num: int | None = ranking.SIMILAR_ITEMS_DEFAULT, block_items: int = BLOCK_ITEMS
) -> tuple[DataFrame, DataFrame]:
    """(best, met): every item's ``num`` most similar ones, and how many blocks it met beside its own.

    ``prepared`` holds the items of one channel as ``content.vectors`` gives them. ``best`` has
    item_id, other_id, score (cosine in thousandths) and rank, as scanning the channel for each item
    would; ties go to the smaller other_id. An item without any attribute scores 0 with all.
    """
    k = ranking.result_size(num, ranking.SIMILAR_ITEMS_DEFAULT)
    spark = prepared.sparkSession
    items = prepared.count()
    if not items:
        nothing = spark.createDataFrame([], f"{FOUND}, rank bigint")
        return nothing, spark.createDataFrame([], "item_id bigint, met bigint, n_blocks int")
    size = max(block_items, min(BLOCK_ITEMS, -(-items // FEW_BLOCKS)), -(-items // MOST_BLOCKS))
    placed = products.stored(in_blocks(prepared, size), "blocks")

    def describe(table: pa.Table) -> pa.Table:
        return _described(table, k)

    # Blocks are small tables and much work.
    blocks = skew.spread(placed, ["block"]).groupBy("block")
    described = blocks.applyInArrow(describe, SUMMARY).toArrow().to_pylist()
    shared = spark.sparkContext.broadcast(described)

    known_blocks: list[Blocks] = []

    def blocks_of(told) -> Blocks:
        if not known_blocks:
            known_blocks.append(Blocks(told.value, k))
        return known_blocks[0]

    def inside(table: pa.Table) -> pa.Table:
        rows = Vectors(table)
        counts, ids, scores = _best(rows, rows, k)
        ends = np.cumsum(counts)
        full = counts == k
        at = np.where(full, ends - 1, 0)
        bars = (np.where(full, part[at], -1) if len(part) else np.full(len(full), -1) for part in (scores, ids))
        to = blocks_of(shared).to_meet(rows, table["block"][0].as_py(), *bars) if k else [np.empty(0, np.int64)] * len(full)
        lists = (_lists(np.split(ids, ends[:-1])), _lists(np.split(scores, ends[:-1])), _lists(to))
        vector = [table[name].combine_chunks() for name in ("item_id", "numbers", "shared", "norm")]
        return pa.table([*vector, *lists], [part.split()[0] for part in OWN.split(", ")])

    own = products.stored(blocks.applyInArrow(inside, OWN), "own-block")
    vector = ["item_id", "numbers", "shared", "norm"]
    asked = own.select(*vector, F.explode("to").alias("to"))
    parts = asked.groupBy("to").agg(F.ceil(F.count("*") / PART_ITEMS).alias("parts"))
    known = skew.measured(parts, ["to"])
    queries = asked.join(known, "to").withColumn("part", skew.part_of("item_id")).drop("parts")
    members = (
        placed.withColumnRenamed("block", "to")
        .join(known, "to")
        .withColumn("part", F.explode(skew.all_parts(F.col("parts").cast("int"))))
        .drop("parts")
    )

    def across(one: pa.Table, other: pa.Table) -> pa.Table:
        asking = Vectors(one)
        counts, ids, scores = _best(asking, Vectors(other), k)
        found = (np.repeat(asking.ids, counts), ids, scores)
        return pa.table([pa.array(column, pa.int64()) for column in found], ["item_id", "other_id", "score"])

    keys = ["to", "part"]
    asking, met = (skew.spread(rows, keys).groupBy(*keys) for rows in (queries, members))
    beyond = asking.cogroup(met).applyInArrow(across, FOUND)
    first = own.select("item_id", F.inline(F.arrays_zip(F.col("ids").alias("other_id"), F.col("scores").alias("score"))))
    best = ranking.top_k(first.unionByName(beyond), ["item_id"], [F.col("score").desc(), F.col("other_id")], k)
    return best, own.select(
        "item_id", F.size("to").cast("bigint").alias("met"), F.lit(len(described)).alias("n_blocks")
    )
