"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks of words.

Each source's documents are shuffled (by a digest of the id) into one stream of words, which is
cut into blocks of ``block_words``. A schedule of slots says which source gives its next block:
the slots are the first 2^m points of the van der Corput sequence, a permutation of m-bit cells,
mapped through the sources' cumulative block counts. Every source so gets exactly the blocks that
its target needs, evenly spread over the whole schedule. Slots are ranked per source, and the rank
is the number of the block that joins to it. A stream that ends early starts again.

At scale: only ids and sizes are shuffled, never texts. A hot source's stream and slots are
numbered in two steps, by counts of small pieces (digest prefixes, runs of slots) and then inside
each piece, so no task holds a source. The join key is (source, block).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.llm.words import word_count, written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 1024
RUN = 1 << 16  # slots that are ranked together
GRID = 4096  # cells for looking up a slot's source
PREFIX = 3  # hex digits of the digest: pieces of a stream


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and the digest that shuffles the source's stream."""
    return docs.select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("digest"),
    )


def targets(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """Each source's words to take: its share by weight, at most ``max_repeats`` times its size.

    Sources in code point order, NULL last, take the weights in turn. With sources in the order
    of limit per weight, those that reach their limit come first; the level for the others is what
    is left over their weights. One row per source.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    turns = F.array(*[F.lit(weight) for weight in weights])
    ranked = by_source.withColumn("place", F.row_number().over(order)).withColumn(
        "weight", F.element_at(turns, (F.col("place") - 1) % len(weights) + 1)
    )
    limits = ranked.withColumn("limit_words", max_repeats * F.col("source_size"))
    by_level = W.orderBy(F.col("limit_words") / F.col("weight"), "place")
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    after = by_level.rowsBetween(W.currentRow, W.unboundedFollowing)
    left = F.sum("source_size").over(W.partitionBy()) - F.coalesce(
        F.sum("limit_words").over(before), F.lit(0)
    )
    levels = limits.withColumn("level", left / F.sum("weight").over(after))
    ratio = F.col("limit_words") / F.col("weight")
    free = F.when(
        F.col("level") * F.col("weight") < F.col("limit_words"), F.struct(ratio, "place", "level")
    )
    common = levels.withColumn("common", F.min(free).over(W.partitionBy())["level"])
    share = F.col("common") * F.col("weight")
    target = F.when(share < F.col("limit_words"), share).otherwise(
        F.col("limit_words").cast("double")
    )
    return common.select(
        "source",
        "place",
        "source_size",
        F.coalesce(target, F.col("limit_words").cast("double")).alias("target"),
    ).withColumn("quota", F.floor(F.col("target") + 0.5))


def schedule(goals: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Slots in the order of the mix: slot, place (source) and block, its rank in the source."""
    spark = goals.sparkSession
    blocks = F.ceil(F.col("quota") / block_words)
    upto = W.orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    spans = goals.select(
        "place", (F.sum(blocks).over(upto) - blocks).alias("first"), F.sum(blocks).over(upto).alias("end")
    ).filter("first < end")
    total = spans.agg(F.max("end")).first()[0] or 0
    bits = max(1, (total - 1).bit_length())
    width = max(1, -(-total // GRID))
    cells = spans.withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("end") - 1) / width)))
    )
    reversed_bits = F.conv(F.reverse(F.lpad(F.bin("id"), bits, "0")), 2, 10).cast("long")
    points = (
        spark.range(1 << bits if total else 0)
        .select(F.col("id").alias("slot"), reversed_bits.alias("point"))
        .filter(F.col("point") < total)
        .withColumn("cell", F.floor(F.col("point") / width))
    )
    drawn = points.join(cells, "cell").filter("point >= first AND point < end")
    runs = drawn.select("slot", "place", F.floor(F.col("slot") / RUN).alias("run"))
    counts = runs.groupBy("place", "run").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("place").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        "place", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")
    )
    inside = F.row_number().over(W.partitionBy("place", "run").orderBy("slot"))
    return (
        runs.withColumn("inside", inside)
        .join(offsets, ["place", "run"])
        .select("slot", "place", (F.col("offset") + F.col("inside") - 1).alias("block"))
    )


def streams(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Each document's half-open span [first, end) in the shuffled stream of its source."""
    placed = sized.join(
        goals.select(F.col("source").alias("of"), "place", "source_size", "target", "quota"),
        F.col("source").eqNullSafe(F.col("of")),
    ).withColumn("piece", F.substring("digest", 1, PREFIX))
    sums = placed.groupBy("place", "piece").agg(F.sum("size").alias("n"))
    earlier = W.partitionBy("place").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        "place", "piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")
    )
    inside = W.partitionBy("place", "piece").orderBy("digest", "doc_id", "size")
    return (
        placed.withColumn("number", F.row_number().over(inside))
        .withColumn("upto", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .join(offsets, ["place", "piece"])
        .withColumn("first", F.col("offset") + F.col("upto") - F.col("size"))
        .withColumn("end", F.col("offset") + F.col("upto"))
        .select(
            "doc_id", "source", "size", "place", "piece", "number", "first", "end", "source_size",
            "target", "quota",
        )
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    block_words: int = BLOCK_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces): every document with its place in the stream, and the mix itself.

    ``pieces`` has the slot, the source's place, the document (doc_id, piece, number), how often its
    stream had started again before (round), and which of its words, [from_word, to_word), are
    taken there; in slot order they are the mix. A source's taken words are those of the slots that
    it was drawn for, which come to its target rounded to whole words.

    NULL ids take a place in the shuffle like an empty id. NULL texts and texts without words have
    size 0 and are never taken. A NULL source is a source. Rows that are repeated are documents of
    their own; ties in the shuffle go by id, then size. An empty table gives two empty results.
    Other columns are not read.
    """
    sized = written(sizes(docs), "mix-sizes")
    goals = written(targets(sized, weights, max_repeats), "mix-targets")
    documents = written(streams(sized, goals), "mix-streams")
    rounds = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))
    parts = (
        documents.filter("size > 0")
        .withColumn("round", rounds)
        .withColumn("begin", F.col("first") + F.col("round") * F.col("source_size"))
        .withColumn("stop", F.least(F.col("end") + F.col("round") * F.col("source_size"), "quota"))
        .filter("begin < stop")
        .withColumn(
            "block",
            F.explode(
                F.sequence(
                    F.floor(F.col("begin") / block_words), F.floor((F.col("stop") - 1) / block_words)
                )
            ),
        )
    )
    start = F.greatest(F.col("begin"), F.col("block") * block_words)
    stop = F.least(F.col("stop"), (F.col("block") + 1) * block_words)
    pieces = parts.join(schedule(goals, block_words), ["place", "block"]).select(
        "slot",
        "place",
        "doc_id",
        "piece",
        "number",
        "round",
        (start - F.col("begin")).alias("from_word"),
        (stop - F.col("begin")).alias("to_word"),
    )
    return documents, pieces


def taken_words(documents: DataFrame, pieces: DataFrame) -> DataFrame:
    """Each document with the number of words that the drawn slots take of it, repeats counted, and
    the first of these slots (NULL if there is none)."""
    keys = ["place", "piece", "number"]
    taken = pieces.groupBy(*keys).agg(
        F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.min("slot").alias("first_slot")
    )
    return documents.join(taken, keys, "left").withColumn(
        "taken", F.coalesce("taken", F.lit(0).cast("long"))
    )
