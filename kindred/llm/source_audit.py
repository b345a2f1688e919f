"""How far the sources of a language differ in their words: a sparse merge per pair of sources.

Terms that enough documents of a language hold are kept. A group (language, source) gives each kept
term a share of a thousand million, smoothed by two; the divergence of two groups is the sum of
(p - q)² / (p + q) over all kept terms, rounded down term by term. Most terms occur in few groups,
so groups are stored sparsely: sorted (term id, share) arrays. A pair of groups is priced from
their two arrays: a galloping intersection finds the terms that both hold, the others on either
side meet the other group's share of an absent term, and terms that neither holds all cost the
same, so only their number counts. The value holds both ways.

At scale: words are counted per task before the shuffle, and a term's rows of all tasks are summed
by (language, source, term). Terms of a language are numbered inside chunks by hash, so no task
sorts a vocabulary, and a pair's merge is split by chunk: a task holds the arrays of a few sources
in one chunk, whatever one source's share of the corpus is. Sources are dealt to tiles; a pair's
task gets its arrays through its pair of tiles, so an array is repeated once per tile, not once per
source. Shares are computed in 64-bit integers, without rounding.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.llm.words import written

# On UTF-8: the bytes of characters beyond ASCII are all above 0x7F, so terms are the same.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
MIN_DOCUMENTS = 10
WHOLE = 1_000_000_000
SMOOTHING = 2
CHUNK_TERMS = 1 << 13
TILE_SOURCES = 8
COUNTED = 1 << 19  # terms that a task counts before it hands them on
COUNTS = "lang string, source string, term string, n bigint, docs bigint"
GROUP = ["lang", "source"]
STRIDE = 512


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, occurrences and documents; a NULL term stands for the group itself.

    NULL text, lang and source are read as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[tuple, Counter] = defaultdict(Counter)
        holders: dict[tuple, Counter] = defaultdict(Counter)

        def counted() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in times.items():
                terms, held = [None, *found], holders[lang, source]
                found[None] = held[None] = 0
                for start in range(0, len(terms), 1 << 16):
                    part = terms[start : start + (1 << 16)]
                    columns = [
                        pa.array([lang] * len(part)),
                        pa.array([source] * len(part)),
                        pa.array(part, pa.binary()).cast(pa.string()),
                        pa.array(list(map(found.__getitem__, part)), pa.int64()),
                        pa.array(list(map(held.__getitem__, part)), pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[p.split()[0] for p in COUNTS.split(", ")])
            times.clear()
            holders.clear()

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = part["text"].cast(pa.binary()).to_pylist()
                for lang, source, text in zip(*(part[name].to_pylist() for name in GROUP), texts):
                    terms = TERM.findall(text.lower())
                    times[lang, source].update(terms)
                    holders[lang, source].update(set(terms))
                if len(times) + sum(map(len, times.values())) >= COUNTED:
                    yield from counted()
        yield from counted()

    texts = docs.select(*[F.coalesce(name, F.lit("")).alias(name) for name in (*GROUP, "text")])
    partial = texts.mapInArrow(run, COUNTS)
    return partial.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column | int, total: Column, terms: Column) -> Column:
    """1 + floor(WHOLE * (n + 2) / (total + 2 * terms)), exactly.

    WHOLE is a thousand three times, and so many digits of the quotient are found at a time; with
    totals up to 9 * 10^15 no product leaves 64 bits, and beyond that Spark raises.
    """
    div = lambda a, b: F.call_function("div", a, b)
    over = total + SMOOTHING * terms
    above = (n if isinstance(n, Column) else F.lit(n)).cast("long") + SMOOTHING
    quotient, rest = div(above, over), above % over
    for _ in range(3):
        rest = rest * 1000
        quotient, rest = quotient * 1000 + div(rest, over), rest % over
    return 1 + quotient


def kept_terms(counts: DataFrame, min_documents: int, chunk_terms: int) -> DataFrame:
    """lang, term, its occurrences in the language, and its number (chunk, id)."""
    by_lang = counts.filter("term IS NOT NULL").groupBy("lang", "term")
    kept = by_lang.agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(
        F.col("docs") >= min_documents
    )
    kept = written(kept.drop("docs"), "audit-kept")
    most = kept.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    chunks = max(1, -(-most // chunk_terms))
    inside = W.partitionBy("lang", "chunk").orderBy("term")
    return kept.withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int")).withColumn(
        "id", F.row_number().over(inside)
    )


def shared_places(small: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values that two sorted arrays share, in each of them.

    Gallops: for each run of the smaller array, steps through the larger one double until they
    pass the run's last value, and only that window is searched.
    """
    if small.size > large.size:
        return shared_places(large, small)[::-1]
    places, at = np.zeros(small.size, np.int64), 0
    for start in range(0, small.size, STRIDE):
        run = small[start : start + STRIDE]
        end, step = at + STRIDE, STRIDE
        while end < large.size and large[end - 1] < run[-1]:
            step *= 2
            end += step
        places[start : start + STRIDE] = at + np.searchsorted(large[at:end], run)
        at = int(places[start + run.size - 1])
    inside = places < large.size
    inside[inside] = large[places[inside]] == small[inside]
    return np.flatnonzero(inside), places[inside]


def price(p: np.ndarray, q: np.ndarray | int) -> np.ndarray:
    """(p - q)² / (p + q), rounded down; shares are at most WHOLE + 1, so squares fit 64 bits."""
    gap = p - q
    return gap * gap // (p + q)


def merge(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int]) -> tuple[int, int]:
    """Summed price of the terms that a or b holds, and their number.

    A side is its sorted ids, their shares, and its share of an absent term.
    """
    (ids_a, p, absent_a), (ids_b, q, absent_b) = a, b
    in_a, in_b = shared_places(ids_a, ids_b)
    only_a, only_b = np.ones(ids_a.size, bool), np.ones(ids_b.size, bool)
    only_a[in_a], only_b[in_b] = False, False
    total = price(p[in_a], q[in_b]).sum() + price(p[only_a], absent_b).sum() + price(q[only_b], absent_a).sum()
    return int(total), ids_a.size + ids_b.size - in_a.size


PAIRS = "lang string, low string, high string, value bigint, held bigint, absent bigint, terms bigint"


def _pairs_of_tiles(table: pa.Table) -> pa.Table:
    """Every unordered pair of sources whose tiles meet here, in one chunk of terms."""
    sides = []
    for row in table.to_pylist():
        ids, shares = np.array(row["ids"], np.int64), np.array(row["shares"], np.int64)
        sides.append((row["source"], row["tile"], (ids, shares, row["absent"]), row))
    sides.sort(key=lambda side: side[0])
    out = []
    for place, (source, tile, side, row) in enumerate(sides):
        for other, other_tile, other_side, _ in sides[place + 1 :]:
            if tile != other_tile or row["a"] == row["b"]:
                value, held = merge(side, other_side)
                absent = int(price(np.int64(side[2]), np.int64(other_side[2]))) if row["terms"] else 0
                out.append((row["lang"], source, other, value, held, absent, row["terms"]))
    kinds = [pa.string()] * 3 + [pa.int64()] * 4
    names = [part.split()[0] for part in PAIRS.split(", ")]
    columns = zip(*out) if out else [[]] * len(names)
    return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def pair_values(rows: DataFrame, groups: DataFrame, tile_sources: int) -> DataFrame:
    """lang, source, item (another source of the language) and value, both ways.

    ``rows`` has a group's kept terms with chunk, id and share, ``groups`` every group with its
    share of an absent term and the number of kept terms of its language.
    """
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    tiles = max(1, -(-most // tile_sources))
    chunks = (rows.agg(F.max("chunk")).first()[0] or 0) + 1
    held = rows.groupBy(*GROUP, "chunk").agg(F.sort_array(F.collect_list(F.struct("id", "p"))).alias("held"))
    arrays = (
        # Every group takes part in every chunk: what it lacks, another may hold.
        groups.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        .join(held, [*GROUP, "chunk"], "left")
        .select(
            *GROUP,
            "chunk",
            "absent",
            "terms",
            F.coalesce("held.id", F.array().cast("array<int>")).alias("ids"),
            F.coalesce("held.p", F.array().cast("array<bigint>")).alias("shares"),
            F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int").alias("tile"),
        )
        .withColumn("opposite", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
        .withColumns({"a": F.least("tile", "opposite"), "b": F.greatest("tile", "opposite")})
        .drop("opposite")
    )
    merged = arrays.groupBy("lang", "chunk", "a", "b").applyInArrow(_pairs_of_tiles, PAIRS)
    value = F.sum("value") + (F.max("terms") - F.sum("held")) * F.max("absent")
    pairs = merged.groupBy("lang", "low", "high").agg(value.alias("value"))
    ways = F.array(
        F.struct(F.col("low").alias("source"), F.col("high").alias("item")),
        F.struct(F.col("high").alias("source"), F.col("low").alias("item")),
    )
    return pairs.select("lang", F.inline(ways), "value")


def audit(
    docs: DataFrame,
    min_documents: int = MIN_DOCUMENTS,
    top_terms: int = 10,
    chunk_terms: int = CHUNK_TERMS,
    tile_sources: int = TILE_SOURCES,
) -> DataFrame:
    """lang, source, part, item, value and rank: for every group its divergence from each other
    source of the language (``pair``), and the terms it uses more than the language does (``term``).

    NULL text, lang and source are empty ones. A group without kept terms still meets all others;
    in a language that keeps no term all values are 0. A language with one source has no pairs.
    Repeated rows are documents of their own. An empty table gives an empty result, other columns
    are not read. Equal values go by item in the order of UTF-8.
    """
    counts = written(term_counts(docs), "audit-counts")
    kept = written(kept_terms(counts, min_documents, chunk_terms), "audit-terms")
    terms_held = counts.filter("term IS NOT NULL").select(*GROUP, "term", "n")
    rows = written(terms_held.join(kept, ["lang", "term"]), "audit-rows")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = rows.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    known = [F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in ("terms", "lang_total", "total")]
    groups = (
        counts.select(*GROUP)
        .distinct()
        .join(langs, "lang", "left")
        .join(totals, GROUP, "left")
        .select(*GROUP, *known)
    )
    absent = F.when(F.col("terms") > 0, share(0, F.col("total"), F.col("terms"))).otherwise(0)
    groups = written(groups.withColumn("absent", absent), "audit-groups")
    shares = rows.join(groups, GROUP).select(
        *GROUP,
        "term",
        "chunk",
        "id",
        share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"),
    )
    order = W.partitionBy(*GROUP).orderBy(F.col("value").desc(), F.col("item"))
    gap = F.col("p") - F.col("q")
    terms = (
        shares.filter("p > q")
        .select(*GROUP, F.col("term").alias("item"), F.call_function("div", gap * gap, F.col("p") + F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top_terms)
    )
    pairs = pair_values(shares, groups, tile_sources).withColumn("rank", F.row_number().over(order))
    return (
        pairs.withColumn("part", F.lit("pair"))
        .unionByName(terms.withColumn("part", F.lit("term")))
        .select(*GROUP, "part", "item", "value", "rank")
    )
