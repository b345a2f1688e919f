"""Line dedup: a sharded minimal perfect hash over the hashes of repeated lines.

1. Every line's key is hashed to 128 bits. A partial aggregation by hash finds the keys of at
   least two documents (smallest id unlike largest), so a line in every document costs one row per
   task.
2. Those keys are cut into shards of about ``SHARD_KEYS``. Per shard one task builds a minimal
   perfect hash and, indexed by it, arrays of fingerprints, counts and owners (smallest ids).
3. Documents send (hash, id, position) of their lines to the shards and probe the arrays there.
   Each shard's arrays are repeated as often as its probes fill groups of ``GROUP_PROBES``, so a
   line that a third of all documents hold is probed by many tasks. No line text is joined.
4. Positions to drop, a small part of the lines, are gathered per document and join its text.

The text is shuffled once, in the last step; the arrays are never broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kindred.llm.words import SPACES, lower_ascii, written

MIN_LENGTH = 10
SHARD_KEYS = 1 << 14
GROUP_PROBES = 1 << 14
ROOM = 2  # slots per key on each level of the hash
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
SHARD_COLUMNS = (
    "shard bigint, sizes binary, taken binary, fingerprints binary, counts binary, owners binary"
)
DROP_COLUMNS = "doc_id bigint, text_hash bigint, pos int"


def _scatter(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * MIX[1]
    values = (values ^ (values >> np.uint64(27))) * MIX[2]
    return values ^ (values >> np.uint64(31))


def _place(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
    """Slot of each 128-bit hash on a level."""
    turn = np.array([level + 1], np.uint64) * MIX[0]
    mixed = _scatter(first + turn) ^ _scatter(second ^ (turn * MIX[1]))
    return (mixed % np.uint64(max(size, 1))).astype(np.int64)


def fingerprint(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _scatter(first ^ MIX[0]) ^ second


class PerfectHash:
    """Minimal perfect hash by levels: a key that has a slot of the level to itself takes it, the
    others go on to the next level. A key's number is the rank of its slot."""

    def __init__(self, sizes: np.ndarray, taken: np.ndarray):
        self.sizes, self.taken = sizes, taken
        self.rank = np.cumsum(taken, dtype=np.int64) - 1
        self.starts = np.concatenate([[0], np.cumsum(sizes)])

    @classmethod
    def build(cls, first: np.ndarray, second: np.ndarray) -> PerfectHash:
        """For distinct pairs of hashes."""
        sizes, levels, level = [], [], 0
        while len(first):
            size = ROOM * len(first)
            slots = _place(first, second, level, size)
            alone = np.bincount(slots, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            again = ~alone[slots]
            first, second, level = first[again], second[again], level + 1
        taken = np.concatenate(levels) if levels else np.zeros(0, bool)
        return cls(np.array(sizes, np.int64), taken)

    def numbers(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Each key's number; -1 or another key's number for a pair that was not built in."""
        found = np.full(len(first), -1, np.int64)
        open_rows = np.arange(len(first))
        for level, size in enumerate(self.sizes):
            if not len(open_rows):
                break
            slots = self.starts[level] + _place(first[open_rows], second[open_rows], level, size)
            hit = self.taken[slots]
            found[open_rows[hit]] = self.rank[slots[hit]]
            open_rows = open_rows[~hit]
        return found


def _hashes(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return tuple(rows[name].to_numpy(np.int64).view(np.uint64) for name in ("first", "second"))


def build_shard(keys: pd.DataFrame) -> pd.DataFrame:
    """One row: the perfect hash of a shard's keys and the arrays that it indexes."""
    first, second = _hashes(keys)
    table = PerfectHash.build(first, second)
    order = np.empty(len(keys), np.int64)
    order[table.numbers(first, second)] = np.arange(len(keys))
    arrays = {
        "shard": int(keys["shard"].iloc[0]),
        "sizes": table.sizes.tobytes(),
        "taken": np.packbits(table.taken).tobytes(),
        "fingerprints": fingerprint(first, second)[order].tobytes(),
        "counts": keys["n"].to_numpy(np.int64)[order].tobytes(),
        "owners": keys["owner"].to_numpy(np.int64)[order].tobytes(),
    }
    return pd.DataFrame([arrays])


def probe_shard(probes: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
    """The probes whose line belongs to another document."""
    empty = probes.iloc[:0][["doc_id", "text_hash", "pos"]]
    if not len(probes) or not len(shard):
        return empty
    row = shard.iloc[0]
    sizes = np.frombuffer(row["sizes"], np.int64)
    taken = np.unpackbits(np.frombuffer(row["taken"], np.uint8), count=int(sizes.sum()))
    table = PerfectHash(sizes, taken.astype(bool))
    first, second = _hashes(probes)
    number = table.numbers(first, second)
    fingerprints = np.frombuffer(row["fingerprints"], np.uint64)
    held = (number >= 0) & (fingerprints[number] == fingerprint(first, second))
    repeated = np.frombuffer(row["counts"], np.int64)[number] > 1
    owner = np.frombuffer(row["owners"], np.int64)[number]
    drop = held & repeated & (owner != probes["doc_id"].to_numpy(np.int64))
    return probes.loc[drop, ["doc_id", "text_hash", "pos"]]


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, a hash of the whole text, position and 128-bit hash of every line that can be
    dropped."""
    keys = F.transform(
        split_lines(F.col("text")), lambda line: lower_ascii(F.btrim(line, F.lit(SPACES)))
    )
    lines = docs.filter("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.posexplode(keys).alias("pos", "key"),
    )
    return lines.filter(F.length("key") >= min_length).select(
        "doc_id",
        "text_hash",
        "pos",
        F.xxhash64("key").alias("first"),
        F.xxhash64(F.lit("second"), "key").alias("second"),
    )


def dropped_lines(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, text_hash and the set of positions to drop, for documents that lose lines."""
    lines = line_hashes(docs, min_length)
    counted = lines.groupBy("first", "second").agg(
        F.min("doc_id").alias("owner"),
        F.max("doc_id").alias("last"),
        F.count("*").alias("n"),
    )
    total = Observation()
    counted = counted.observe(total, F.sum("n").alias("lines"))
    keys = written(counted.filter("owner != last").drop("last"), "line-keys")
    shards = max(1, -(-keys.count() // SHARD_KEYS))

    def shard(frame: DataFrame) -> DataFrame:
        return frame.withColumn("shard", F.pmod("first", F.lit(shards).cast("long")))

    built = shard(keys).groupBy("shard").applyInPandas(build_shard, SHARD_COLUMNS)
    arrays = written(built, "line-shards")
    hits = shard(keys).groupBy("shard").agg(F.sum("n").alias("hits"))
    others = (total.get.get("lines") or 0) / shards
    parts = written(
        hits.select("shard", F.ceil((F.col("hits") + F.lit(others)) / GROUP_PROBES).alias("parts")),
        "line-parts",
    )
    probes = shard(lines).join(parts, "shard").withColumn(
        "part", F.pmod(F.xxhash64("doc_id"), "parts")
    )
    spread = arrays.join(parts, "shard").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    )
    found = (
        probes.drop("parts")
        .groupBy("shard", "part")
        .cogroup(spread.drop("parts").groupBy("shard", "part"))
        .applyInPandas(probe_shard, DROP_COLUMNS)
    )
    return found.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("dropped"))


def drop_repeated_lines(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """One row per row of ``docs``: the row itself as the struct ``doc``, the kept ``text``,
    ``n_lines`` before and ``n_dropped``.

    A line's key is the line without white space at its ends, A-Z in lower case. Keys of at least
    ``min_length`` code points that at least two documents hold stay only in the document with the
    smallest id. NULL and empty texts are one empty line. Rows without an id keep all lines and
    hold none. Rows with the same id are one document. An empty table gives an empty result.
    Other columns, whatever their names, are inside ``doc``.
    """
    drops = dropped_lines(docs, min_length).select(
        F.col("doc_id").alias("of"), F.col("text_hash").alias("of_text"), "dropped"
    )
    rows = docs.select(F.struct("*").alias("doc")).withColumn(
        "text_hash", F.xxhash64("doc.text")
    )
    joined = rows.join(
        drops.hint("shuffle_hash"),
        (F.col("doc.doc_id") == F.col("of")) & (F.col("text_hash") == F.col("of_text")),
        "left",
    )
    lines = joined.select(
        "doc",
        split_lines(F.col("doc.text")).alias("lines"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
    )
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.transform(F.array_except(places, "dropped"), lambda at: F.get(F.col("lines"), at))
    return lines.select(
        "doc",
        F.when(F.size("dropped") == 0, F.coalesce("doc.text", F.lit("")))
        .otherwise(F.array_join(kept, "\n"))
        .alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("dropped").cast("long").alias("n_dropped"),
    )
