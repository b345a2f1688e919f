"""Near duplicates by min-max hashing, confirmed on full shingle sets.

1. A map over the texts gives each document the size of its shingle set, a 128-bit digest of its
   word sequence, and band hashes of its min-max signature: each permutation gives a minimum and a
   maximum, so 24 bands of 4 values need 48 permutations. Two large sets with a similarity of 0.8
   share no band with a probability of about 3 in a million. In small sets a minimum tells something
   about the maximum: for 4 of 5 shingles in common it is about 2 in 100,000.
2. Documents with equal digests are one class, known by its smallest id. Only classes go on.
3. Classes that share a band hash lie in a bucket. The class of a bucket that has most company over
   all its buckets is its centre: in a group of copies of one original that is the one most like
   the others. Pairs are (centre, member), at most one per member and bucket.
4. The texts of these classes, and no others, are joined; their full sets are compared with the
   centre's. A large group is cut into chunks, and the centre's set goes to each.
5. Members unlike their centre may be like another member. Within a group they are compared with
   all members, in tiles of blocks: counts of common shingles come from one inverted index a tile,
   and a tile returns only the links that join something new. No pairs are emitted on the way.
6. Connected components over the links give each class its smallest reachable id.

So every pair that shares a bucket is compared or known to be connected; there is no cap on
buckets or groups. The texts are shuffled once, without sorting.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.arrow import map_slices
from kindred.llm.components import connected
from kindred.llm.shingles import Shingler
from kindred.llm.words import written

BANDS = 24
CHUNK = 512  # members of a group that are compared with its centre in one task
OPEN_BLOCK, MEMBER_BLOCK = 64, 256  # sides of a tile
SIGNED = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>"
SETS = (
    "centre bigint, chunk bigint, member bigint, is_centre boolean, shingles binary"
)
COMPARED = "centre bigint, chunk bigint, member bigint, linked boolean, shingles binary"
SALTS = 16  # tasks that the pairs of one centre are dealt to


def signatures(docs: DataFrame, size: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, digest and band hashes (none without words) of every row."""

    def make():
        shingler = Shingler(size, bands)

        def sign(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {name: [] for name in ("n_shingles", "d1", "d2", "bands")}
            for text in batch["text"].to_pylist():
                words = shingler.words(text or "")
                found = shingler.set_of(words)
                first, second = shingler.digest(words)
                out["n_shingles"].append(len(found))
                out["d1"].append(first)
                out["d2"].append(second)
                out["bands"].append(shingler.band_hashes(found) if len(found) else [])
            return {"doc_id": batch["doc_id"], **out}

        return sign

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, SIGNED)


def stars(classes: DataFrame) -> DataFrame:
    """(centre, member) of all buckets, each pair once."""
    banded = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    inside = written(banded.join(shared, "bucket"), "near-buckets")
    company = inside.groupBy("rep").agg(F.sum("n").alias("company"))
    centres = (
        inside.join(company, "rep")
        .groupBy("bucket")
        .agg(F.max(F.struct("company", -F.col("rep")))["col2"].alias("minus"))
        .select("bucket", (-F.col("minus")).alias("centre"))
    )
    return (
        inside.join(centres, "bucket")
        .filter("rep != centre")
        .select("centre", F.col("rep").alias("member"))
        .distinct()
    )


def group_sets(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """Shingle sets of members, and of centres in every chunk of their group."""
    chunks = pairs.groupBy("centre").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    # A hot centre's pairs meet its count in several tasks.
    salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("member", F.lit(3)), F.lit(SALTS).cast("long")))
    members = salted.join(chunks.select("*", salt), ["centre", "salt"]).select(
        F.col("member").alias("rep"),
        F.struct("centre", F.pmod(F.xxhash64("member"), "chunks").alias("chunk"), "chunks").alias("place"),
    )
    centres = chunks.select(
        F.col("centre").alias("rep"), F.struct("centre", F.lit(0).cast("long").alias("chunk"), "chunks").alias("place")
    )
    nodes = (
        members.unionAll(centres)
        .groupBy("rep")
        .agg(F.collect_list("place").alias("places"))
        .join(classes.select("rep", "d1"), "rep")
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(
        nodes.hint("shuffle_hash"), "rep"
    )

    def make():
        shingler = Shingler(size, 1)

        def sets(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {name: [] for name in SET_NAMES}
            for row in batch.to_pylist():
                words = shingler.words(row["text"] or "")
                if shingler.digest(words)[0] != row["d1"]:
                    continue  # another text under the same id
                packed = shingler.set_of(words).tobytes()
                for place in row["places"]:
                    own = place["centre"] == row["rep"]
                    for chunk in range(place["chunks"]) if own else [place["chunk"]]:
                        out["centre"].append(place["centre"])
                        out["chunk"].append(chunk)
                        out["member"].append(row["rep"])
                        out["is_centre"].append(own)
                        out["shingles"].append(packed)
            return out

        return sets

    return map_slices(texts, make, SETS, 64)


SET_NAMES = [part.split()[0] for part in SETS.split(", ")]
COMPARED_SCHEMA = pa.schema(
    [
        ("centre", pa.int64()), ("chunk", pa.int64()), ("member", pa.int64()), ("linked", pa.bool_()),
        ("shingles", pa.binary()),
    ]
)
LINK_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(value, np.uint64) for value in table["shingles"].to_pylist()]


def common_counts(one: np.ndarray, values: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """How many elements of a set each of n sets holds; ``values`` are all their elements sorted,
    ``owners`` the set of each."""
    low, high = (np.searchsorted(values, one, side) for side in ("left", "right"))
    lengths = high - low
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(n, np.int64)
    places = np.arange(ends[-1]) + np.repeat(low - (ends - lengths), lengths)
    return np.bincount(owners[places], minlength=n)


def inverted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.concatenate(sets)
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    return flat[order], owners[order]


def alike(common: np.ndarray, size: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (size + sizes - common)


def compare_with_centre(percent: int):
    """Marks the members of a chunk that are linked with the centre."""

    def compare(group: pa.Table) -> pa.Table:
        own = np.array(group["is_centre"].to_pylist(), bool)
        sets = _sets(group)
        centre = [s for s, flag in zip(sets, own) if flag]
        rows = np.flatnonzero(~own)
        if not centre or not len(rows):
            return COMPARED_SCHEMA.empty_table()
        members = [sets[i] for i in rows]
        common = common_counts(centre[0], *inverted(members), len(members))
        sizes = np.array([len(s) for s in members])
        taken = group.take(pa.array(rows))
        return pa.table(
            [
                taken["centre"],
                taken["chunk"],
                taken["member"],
                pa.array(alike(common, len(centre[0]), sizes, percent)),
                taken["shingles"],
            ],
            schema=COMPARED_SCHEMA,
        )

    return compare


def compare_members(percent: int):
    """Links within a tile that join what its links so far have not. Members linked with the
    centre are joined through it already."""

    def compare(open_rows: pa.Table, members: pa.Table) -> pa.Table:
        if not open_rows.num_rows or not members.num_rows:
            return LINK_SCHEMA.empty_table()
        settled = np.array(members["linked"].to_pylist(), bool)
        ids = np.array(members["member"].to_pylist(), np.int64)
        sets = _sets(members)
        sizes = np.array([len(s) for s in sets])
        values, owners = inverted(sets)
        parent: dict[int, int] = {}

        def root(node: int) -> int:
            while parent.setdefault(node, node) != node:
                parent[node] = node = parent[parent[node]]
            return node

        first = int(ids[settled][0]) if settled.any() else None
        for node in ids[settled].tolist():
            parent[root(node)] = root(first)
        links = []
        for node, found in zip(open_rows["member"].to_pylist(), _sets(open_rows)):
            common = common_counts(found, values, owners, len(sets))
            hits = alike(common, len(found), sizes, percent) & (ids != node)
            for other in ids[hits].tolist():
                if root(node) != root(other):
                    parent[root(node)] = root(other)
                    links.append((node, other))
        a, b = zip(*links) if links else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=LINK_SCHEMA)

    return compare


def member_links(compared: DataFrame, percent: int) -> DataFrame:
    """Links between members of a group, of which one is not linked with the centre."""
    counts = (
        compared.groupBy("centre")
        .agg(
            F.count("*").alias("n"),
            F.count_if(~F.col("linked")).alias("n_open"),
            F.max("chunk").alias("last_chunk"),
        )
        .filter("n_open > 0 AND n > 1")
        .select(
            "centre",
            "last_chunk",
            F.ceil(F.col("n_open") / OPEN_BLOCK).alias("open_blocks"),
            F.ceil(F.col("n") / MEMBER_BLOCK).alias("member_blocks"),
        )
    )
    zero = F.lit(0).cast("long")
    # Rows carry sets, and meet the count of their group by the chunk they were compared in.
    spread = counts.select("*", F.explode(F.sequence(zero, F.col("last_chunk"))).alias("chunk"))
    rows = compared.join(spread.drop("last_chunk"), ["centre", "chunk"])

    def every(blocks: str):
        return F.explode(F.sequence(zero, F.col(blocks) - 1))

    open_rows = (
        rows.filter(~F.col("linked"))
        .withColumn("open_block", F.pmod(F.xxhash64("member", F.lit(1)), "open_blocks"))
        .withColumn("member_block", every("member_blocks"))
    )
    members = rows.withColumn(
        "member_block", F.pmod(F.xxhash64("member", F.lit(2)), "member_blocks")
    ).withColumn("open_block", every("open_blocks"))
    key = ["centre", "open_block", "member_block"]
    kept = [*key, "member", "linked", "shingles"]
    return (
        open_rows.select(*kept)
        .groupBy(*key)
        .cogroup(members.select(*[F.col(name).alias(name) for name in kept]).groupBy(*key))
        .applyInArrow(compare_members(percent), "a bigint, b bigint")
    )


def near_duplicates(
    docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = BANDS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id and kept.

    A document's set is its distinct shingles of ``shingle_words`` words, A-Z in lower case; a
    shorter text is one shingle. Two documents are linked if 100 * intersection >= ``percent`` *
    union. component_id is the smallest doc_id reachable over links, kept says whether that is the
    document's own.

    NULL and empty texts and those without words have an empty set, are linked with nothing and
    kept, also when they are equal. Rows without an id are linked with nothing and kept, with a
    NULL component. Rows that share an id are one document; if their texts differ, the one with the
    smallest digest is compared. An empty table gives an empty result. Other columns are not read.
    """
    signed = written(signatures(docs, shingle_words, bands), "near-signatures")
    named = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    single = named.groupBy("doc_id").agg(F.min(F.struct("d1", "d2", "bands")).alias("own"))
    classes = written(
        single.groupBy("own.d1", "own.d2").agg(
            F.min("doc_id").alias("rep"), F.first("own.bands").alias("bands")
        ),
        "near-classes",
    )
    pairs = written(stars(classes), "near-pairs")
    sets = group_sets(docs, classes, pairs, shingle_words)
    compared = written(
        sets.groupBy("centre", "chunk").applyInArrow(compare_with_centre(percent), COMPARED),
        "near-compared",
    )
    links = compared.filter("linked").select(F.col("centre").alias("a"), F.col("member").alias("b"))
    labels = connected(links.unionAll(member_links(compared, percent)))
    # Rows of one id may have several texts, so the id leads to its class.
    reps = single.select("doc_id", "own.d1", "own.d2").join(
        classes.select("d1", "d2", "rep"), ["d1", "d2"]
    )
    components = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", F.coalesce("component", "rep").alias("component")
    )
    return (
        signed.select("doc_id", "n_shingles")
        .join(components, "doc_id", "left")
        .withColumn(
            "component_id",
            F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")),
        )
        .select(
            "doc_id",
            "n_shingles",
            "component_id",
            F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        )
    )
