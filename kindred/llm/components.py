"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.words import written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "to"))).first()
    return row[0], row[1]


def connected(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node of the links (a, b) that is
    not its component's smallest.

    Edges stay pairs, never lists of neighbours: a round joins each edge with the smallest
    neighbour of its end, so the work on a hot node spreads. A round writes its edges, and the
    number of rounds grows with the logarithm of a component's width.
    """
    edges = written(
        links.filter("a != b")
        .select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to"))
        .distinct(),
        "edges",
    )
    state = _state(edges)
    while state[0]:
        both = edges.unionAll(edges.select(F.col("to").alias("node"), F.col("node").alias("to")))
        least = both.groupBy("node").agg(F.min("to").alias("least"))
        large = (
            both.join(least.withColumn("least", F.least("least", "node")), "node")
            .filter("to > node")
            .select(F.col("to").alias("node"), F.col("least").alias("to"))
            .distinct()
        )
        large = written(large, "large-star")
        root = large.groupBy("node").agg(F.min("to").alias("least"))
        small = (
            large.join(root, "node")
            .filter("to != least")
            .select(F.col("to").alias("node"), F.col("least").alias("to"))
            .unionAll(root.select("node", F.col("least").alias("to")))
            .distinct()
        )
        edges, before = written(small, "small-star"), state
        state = _state(edges)
        if state == before:
            break
    return edges.select("node", F.col("to").alias("component"))
