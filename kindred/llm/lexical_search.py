"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds no postings. Documents of like size lie in groups; for each group there is a
matrix of bits with a row per position of the signature and a column per document. A term sets
``HASHES`` rows for every level of its frequency that the document reaches (1, 2, 3, 4, 6, 8, …
occurrences), so the AND of a term's rows is a bitmap of the documents that may hold it so often:
never too few, seldom too many. For an item, the bitmaps of its terms, weighted and summed, give an
upper bound of every document's score in a few operations per slice.

A search first takes the documents with the highest bounds and scores them exactly, from their
texts; the k-th best of these exact scores is a bar. Every document whose bound reaches the bar
(with equal bounds, up to the id that holds it) is then scored exactly. The rest provably can't be
among the k best, so the result is exact.

At scale: the index is made by one map over the texts, with memory bounded by its groups, and is
a small part of the texts. Searches read the slices twice and join the texts twice with the
documents asked for, by shuffle unless their measured size is small. Items are answered in blocks
of a bounded number of terms; per task, at most k documents an item leave the first pass.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.llm.arrow import map_slices
from kindred.llm.words import written
from kindred.operators import skew

# On UTF-8: the bytes of characters beyond ASCII are all above 0x7F, so terms are the same.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
HASHES = 3
BITS_PER_ENTRY = 16  # rows of the signature per (term, level) of the largest document
GROUP_DOCS, GROUP_ENTRIES = 1024, 1 << 20
MOST_ROWS = 1 << 22  # larger documents get denser signatures, that is looser bounds
RECENT_TERMS, COUNTED_TERMS = 1 << 18, 1 << 19
BLOCK_TERMS = 1 << 15  # terms of the items that are answered together
LEVELS = np.array(sorted({1, *(2**k for k in range(1, 40)), *(3 * 2**k for k in range(39))}))
INDEX = (
    "term string, df bigint, n_docs bigint, n_terms bigint, entries bigint, ids binary, "
    "known binary, sizes binary, most binary, slices binary"
)
NO_ID = np.iinfo(np.int64).max  # stands for a NULL id, which comes last among ties
MIXER = np.array(0x9E3779B97F4A7C15, np.uint64)


def terms_of(text: bytes | None) -> list[bytes]:
    """Letters and digits of ASCII and everything beyond it, with A-Z in lower case, from UTF-8."""
    return TERM.findall(text.lower()) if text else []


def utf8(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch["text"].cast(pa.binary()).to_pylist()


class _Hashes(dict):
    """64-bit hashes of recent terms."""

    def __missing__(self, term: bytes) -> int:
        if len(self) >= RECENT_TERMS:
            self.clear()
        found = self[term] = xxhash.xxh3_64_intdigest(term)
        return found


def at_level(hashes: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    """Hashes of (term, level): a mix of the term's hash and the level's number."""
    step = (np.asarray(level, np.uint64) + np.uint64(1)) * MIXER
    mixed = (hashes + step) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


def rows_of(hashes: np.ndarray, height: int) -> np.ndarray:
    """The rows that each hash sets in a signature of ``height`` rows, by double hashing."""
    first = hashes >> np.uint64(32)
    step = (hashes & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    numbers = np.arange(HASHES, dtype=np.uint64)
    return ((first[:, None] + numbers * step[:, None]) % np.uint64(height)).astype(np.int64)


def height_of(entries: int) -> int:
    return min(BITS_PER_ENTRY * entries, MOST_ROWS)


class GroupWriter:
    """Gathers documents by the power of two that bounds their entries, and packs full groups."""

    def __init__(self):
        self.open: dict[int, list] = defaultdict(list)
        self.hashes = _Hashes()

    def add(self, doc_id: int | None, counts: Counter) -> dict | None:
        """A row of the index once the document completes its group."""
        hashes = np.fromiter(map(self.hashes.__getitem__, counts), np.uint64, len(counts))
        times = np.fromiter(counts.values(), np.int64, len(counts))
        most = int(times.max())
        # A term has an entry for each level up to its frequency.
        reached = np.searchsorted(LEVELS, times, "right")
        ends = np.cumsum(reached)
        level = np.arange(ends[-1]) - np.repeat(ends - reached, reached)
        entries = at_level(np.repeat(hashes, reached), level)
        bound = max(8, 1 << (entries.size - 1).bit_length())
        group = self.open[bound]
        group.append((doc_id, int(times.sum()), most, entries))
        if len(group) >= max(8, min(GROUP_DOCS, GROUP_ENTRIES // bound)):
            return self.packed(bound)
        return None

    def packed(self, bound: int) -> dict:
        group = self.open.pop(bound)
        height = height_of(bound)
        bits = np.zeros((height, len(group)), bool)
        for place, (*_, entries) in enumerate(group):
            bits[rows_of(entries, height).reshape(-1), place] = True
        ids, sizes, most, _ = zip(*group)
        return {
            "n_docs": len(group),
            "n_terms": sum(sizes),
            "entries": bound,
            "ids": np.array([NO_ID if i is None else i for i in ids], "<i8").tobytes(),
            "known": np.array([i is not None for i in ids], np.uint8).tobytes(),
            "sizes": np.array(sizes, "<i8").tobytes(),
            "most": np.array(most, "<i8").tobytes(),
            "slices": np.packbits(bits, axis=1).tobytes(),
        }

    def rest(self) -> Iterator[dict]:
        for bound in list(self.open):
            yield self.packed(bound)


@dataclass(frozen=True)
class Index:
    """The written index: groups of signatures, documents per term as each task counted them, and
    what they sum up to."""

    groups: DataFrame
    terms: DataFrame
    documents: int
    words: int

    def holders(self, terms: DataFrame) -> DataFrame:
        """How many documents hold each of some terms. These are few, so they pick the rows to sum
        before any shuffle."""
        found = self.terms.join(skew.measured(terms.select("term").distinct(), ["term"]), "term")
        return found.groupBy("term").agg(F.sum("df").alias("df"))


def build_index(docs: DataFrame) -> Index:
    """Signatures of all documents with at least one term, and every term's documents.

    Each row is a document of its own. NULL texts have no terms.
    """
    schema = pa.schema(
        [
            pa.field(name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[kind])
            for name, kind in (part.split() for part in INDEX.split(", "))
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, df = GroupWriter(), Counter()

        def counted() -> Iterator[pa.RecordBatch]:
            terms, numbers = [term.decode() for term in df], list(df.values())
            df.clear()
            for start in range(0, len(terms), 1 << 16):
                part = slice(start, start + (1 << 16))
                columns = {"term": terms[part], "df": numbers[part]}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns.get(f.name, [None] * len(columns["term"])), f.type) for f in schema],
                    schema=schema,
                )

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for doc_id, text in zip(part["doc_id"].to_pylist(), utf8(part)):
                    counts = Counter(terms_of(text))
                    if not counts:
                        continue
                    df.update(counts.keys())
                    row = writer.add(doc_id, counts)
                    if row:
                        yield pa.RecordBatch.from_pylist([row], schema)
                if len(df) >= COUNTED_TERMS:
                    yield from counted()
        for row in writer.rest():
            yield pa.RecordBatch.from_pylist([row], schema)
        yield from counted()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stored = written(texts.mapInArrow(run, INDEX), "lexical-index")
    groups = stored.filter("slices IS NOT NULL").drop("term", "df")
    terms = stored.filter("term IS NOT NULL").select("term", "df")
    n_docs, n_terms = groups.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    return Index(groups, terms, n_docs or 0, n_terms or 0)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and each of its terms once; the rows of one item_id are one item."""

    def make():
        def rows(batch: pa.RecordBatch) -> dict:
            texts = zip(batch["item_id"].to_pylist(), utf8(batch))
            found = [(item, term.decode()) for item, text in texts for term in set(terms_of(text))]
            return {"item_id": [item for item, _ in found], "term": [term for _, term in found]}

        return rows

    kind = items.schema["item_id"].dataType.simpleString()
    return map_slices(items.select("item_id", "text"), make, f"item_id {kind}, term string").distinct()


@dataclass(frozen=True)
class Block:
    """Items that are answered together: their terms with weights, and items as places of terms."""

    terms: list[bytes]
    weights: np.ndarray
    items: list[np.ndarray]
    words_per_document: tuple[int, int]  # words and documents of the corpus

    def sizes(self, n: np.ndarray) -> np.ndarray:
        """What the length of a document adds to the denominator: its m, times 20."""
        words, documents = self.words_per_document
        return 20 * (100 - 50 + (50 * n * documents) // words)

    def score(self, item: int, counts: dict[bytes, int], size: int) -> int:
        """The exact score of a document for an item."""
        total = 0
        for place in self.items[item]:
            times = counts.get(self.terms[place], 0)
            if times:
                total += int(self.weights[place]) * ((1_000_000_000 * times) // (1000 * times + size))
        return total


def upper_bounds(block: Block, group: dict, hashes: np.ndarray) -> np.ndarray:
    """A bound of each document's score for each item, one row per item."""
    n_docs, height = group["n_docs"], height_of(group["entries"])
    slices = np.frombuffer(group["slices"], np.uint8).reshape(height, -1)
    sizes, most = (np.frombuffer(group[name], "<i8") for name in ("sizes", "most"))
    extra = block.sizes(sizes)
    bounds = np.zeros((len(block.items), n_docs), np.int64)
    left = np.arange(len(block.terms))
    held = np.full((len(left), slices.shape[1]), 255, np.uint8)
    below = np.zeros(n_docs, np.int64)
    place_of = np.empty(len(block.terms), np.int64)
    for level in range(len(LEVELS) - 1):
        rows = rows_of(at_level(hashes[left], level), height)
        for number in range(HASHES):
            held &= slices[rows[:, number]]
        some = held.any(axis=1)
        left, held = left[some], held[some]
        if not left.size:
            break
        # With this level and not the next, a term occurs so often at most.
        times = np.minimum(LEVELS[level + 1] - 1, most)
        factor = (1_000_000_000 * times) // (1000 * times + extra)
        gain, below = factor - below, factor
        bits = np.unpackbits(held, axis=1, count=n_docs).astype(np.float64)
        place_of[:] = -1
        place_of[left] = np.arange(left.size)
        for item, terms in enumerate(block.items):
            places = place_of[terms]
            found = places >= 0
            if found.any():
                # Sums of weights stay far below 2^53, so they are exact.
                bounds[item] += (block.weights[terms[found]] @ bits[places[found]]).astype(np.int64) * gain
    return bounds


BOUNDED = "item int, doc_id bigint, known boolean, bound bigint"


def _bounded(groups: DataFrame, block: Block, pick) -> DataFrame:
    """Documents and bounds that ``pick(state, bounds, ids)`` lets through, per task."""
    shared = groups.sparkSession.sparkContext.broadcast(block)
    names = [part.split()[0] for part in BOUNDED.split(", ")]

    def rows(item: np.ndarray, ids: np.ndarray, known: np.ndarray, bounds: np.ndarray):
        columns = [item.astype(np.int32), ids, known, bounds]
        return pa.RecordBatch.from_arrays([pa.array(column) for column in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        hashes = np.array([xxhash.xxh3_64_intdigest(term) for term in block.terms], np.uint64)
        choose = pick()
        for batch in batches:
            for number in range(batch.num_rows):
                (group,) = batch.slice(number, 1).to_pylist()
                ids = np.frombuffer(group["ids"], "<i8")
                known = np.frombuffer(group["known"], np.uint8).astype(bool)
                for found in choose(upper_bounds(block, group, hashes), ids, known):
                    yield rows(*found)
        for found in choose(None, None, None):
            yield rows(*found)

    return groups.mapInArrow(run, BOUNDED)


def highest_bounds(groups: DataFrame, block: Block, k: int) -> DataFrame:
    """The k documents of each item with the highest bounds."""

    def pick():
        best: dict[int, tuple] = {}

        def choose(bounds, ids, known):
            if bounds is None:
                for item, (top, top_ids, top_known) in best.items():
                    yield np.full(top.size, item), top_ids, top_known, top
                return
            for item, row in enumerate(bounds):
                places = np.flatnonzero(row > 0)
                if not places.size:
                    continue
                found = (row[places], ids[places], known[places])
                if item in best:
                    found = tuple(map(np.concatenate, zip(best[item], found)))
                order = np.lexsort((found[1], -found[0]))[:k]
                best[item] = tuple(column[order] for column in found)

        return choose

    found = _bounded(groups, block, pick)
    order = W.partitionBy("item").orderBy(F.col("bound").desc(), F.col("doc_id"))
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).drop("n")


def not_excluded(groups: DataFrame, block: Block, bars: list[tuple[int, int]]) -> DataFrame:
    """Documents whose bound reaches the bar of the item: (score, id) of its k-th best so far."""
    scores, last = np.array([score for score, _ in bars]), np.array([doc_id for _, doc_id in bars])

    def pick():
        def choose(bounds, ids, known):
            if bounds is None:
                return
            reach = bounds > scores[:, None]
            reach |= (bounds == scores[:, None]) & (ids <= last[:, None]) & (bounds > 0)
            item, place = np.nonzero(reach)
            yield item, ids[place], known[place], bounds[item, place]

        return choose

    return _bounded(groups, block, pick)


SCORED = "item int, doc_id bigint, score bigint"


def exact_scores(docs: DataFrame, wanted: DataFrame, block: Block) -> DataFrame:
    """Scores above 0 of the documents wanted, from their whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    asked = wanted.select(F.when(F.col("known"), F.col("doc_id")).alias("asked"), "item")
    by_document = asked.groupBy("asked").agg(F.collect_set("item").alias("items"))

    def make():
        block = shared.value

        def score(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"item": [], "doc_id": [], "score": []}
            rows = zip(batch["doc_id"].to_pylist(), utf8(batch), batch["items"].to_pylist())
            for doc_id, text, items in rows:
                counts = Counter(terms_of(text))
                size = int(block.sizes(sum(counts.values()))) if counts else 0
                for item in items:
                    score = block.score(item, counts, size)
                    if score > 0:
                        out["item"].append(item)
                        out["doc_id"].append(doc_id)
                        out["score"].append(score)
            return out

        return score

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # ``items`` has at most one number per item of the block.
    found = texts.join(skew.measured(by_document, ["asked"]), F.col("doc_id").eqNullSafe(F.col("asked")))
    return map_slices(found.select("doc_id", "text", "items"), make, SCORED, 64)


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def weight(df: Column, documents: int) -> Column:
    ratio = F.lit(float(2 * documents + 2)) / (2 * df + 1)
    return F.floor(1000 * F.log(ratio)).cast("long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents with a score above 0.

    Ties go by ascending doc_id, NULL ids last. Every row of ``docs`` is a document, so a repeated
    one takes a rank per row. Rows of ``items`` that share an item_id are one item with the terms
    of all of them; NULL is an item_id like others. NULL and empty texts have no terms: such
    documents are never found, such items find none. With either table empty the result is empty.
    Other columns are not read. The result is a table in the shared work folder.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    empty = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    index = build_index(docs)
    if not index.documents:
        return empty
    terms = written(item_terms(items), "lexical-terms")
    known = terms.join(index.holders(terms), "term").select(
        "item_id", "term", weight(F.col("df"), index.documents).alias("weight")
    )
    # Items are numbered by their ids; there is one row per item here, not per document.
    per_item = known.groupBy("item_id").agg(F.count("*").alias("n"))
    order = W.orderBy("item_id")
    placed = per_item.select(
        F.col("item_id").alias("of"),
        F.floor((F.sum("n").over(order) - F.col("n")) / block_terms).alias("block"),
    )
    asked = written(
        known.join(placed, F.col("item_id").eqNullSafe(F.col("of"))).drop("of"), "lexical-items"
    )
    results = []
    for (number,) in asked.select("block").distinct().orderBy("block").collect():
        block, item_ids = _block(asked.filter(F.col("block") == number), index)
        first = written(
            _best(exact_scores(docs, highest_bounds(index.groups, block, k), block), k), "lexical-first"
        )
        bars = [(0, NO_ID)] * len(block.items)
        for item, doc_id, score in first.filter(F.col("rank") == k).select("item", "doc_id", "score").collect():
            bars[item] = (score, NO_ID if doc_id is None else doc_id)
        best = _best(exact_scores(docs, not_excluded(index.groups, block, bars), block), k)
        names = spark.createDataFrame(list(enumerate(item_ids)), f"item int, item_id {kind}")
        results.append(
            written(best.join(names, "item").select("item_id", "rank", "doc_id", "score"), "lexical-found")
        )
    for found in results:
        empty = empty.unionByName(found)
    return empty


def _block(asked: DataFrame, index: Index) -> tuple[Block, list]:
    """The items of one block on the driver: at most the block's terms and one item's."""
    rows = asked.select("item_id", "term", "weight").toArrow().to_pylist()
    weights = {row["term"]: row["weight"] for row in rows}
    place = {term: number for number, term in enumerate(sorted(weights))}
    items: dict = defaultdict(list)
    for row in rows:
        items[row["item_id"]].append(place[row["term"]])
    item_ids = sorted(items, key=lambda item: (item is None, item or 0))
    return (
        Block(
            [term.encode() for term in place],
            np.array([weights[term] for term in place], np.int64),
            [np.array(sorted(items[item]), np.int64) for item in item_ids],
            (index.words, index.documents),
        ),
        item_ids,
    )
