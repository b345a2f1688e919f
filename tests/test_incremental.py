"""Pairs kept up by batches against full runs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kindred.operators import deltas, similarity
from kindred.plans import algorithms, incremental
from kindred.session import work_folder
from kindred.sources import batches

SCHEMA = "channel_id string, user_id bigint, item_id bigint, action string, rating double"


@pytest.fixture(scope="module")
def rows():
    """Three batches; one user holds a third of the rows, and rows come again in later batches."""
    draw = random.Random(4)
    out = [[], [], []]
    for batch in out:
        for _ in range(150):
            user = 0 if draw.random() < 0.35 else draw.randint(1, 25)
            rated = draw.random() < 0.6
            batch.append(
                ("CH/1" if draw.random() < 0.8 else "CH-2", user, draw.randint(0, 30),
                 "rating" if rated else draw.choice(["view", "buy"]), float(draw.randint(1, 5)) if rated else None)
            )
    out[1] += out[0][:40]
    out[2] += [("CH/1", None, 3, "view", None), ("CH/1", 3, None, "view", None)]
    return out


def scores(frame):
    return sorted((r["item_id"], r["other_id"], r["score"]) for r in frame.collect())


@pytest.mark.parametrize("base, actions", [("loglikelihood", ()), ("cosine", ("view", "rating")), ("pearson", ())])
def test_equal_to_a_full_run_after_each_batch(spark, rows, base, actions):
    root = work_folder(spark, "kept-up")
    algorithm = algorithms.Algorithm("CH/1", "AL%1", base, actions)
    seen = []
    for number, batch in enumerate(rows):
        seen += batch
        assert incremental.update(spark, root, algorithm, spark.createDataFrame(batch, SCHEMA), number)
        assert not incremental.update(spark, root, algorithm, spark.createDataFrame(batch, SCHEMA), number)
        mine = spark.createDataFrame(seen, SCHEMA).where("channel_id = 'CH/1'")
        want = scores(similarity.similarity(mine, base, actions, by=()))
        assert len(want) > 100
        assert scores(incremental.similarities(spark, root, algorithm)) == want
        if number == 1:
            assert incremental.compact(spark, root) == 1
            incremental.clean(spark, root, older_than_ms=-1000)
            assert not incremental.update(spark, root, algorithm, spark.createDataFrame(batch, SCHEMA), 0)
            assert scores(incremental.similarities(spark, root, algorithm)) == want


@pytest.mark.parametrize("block", [3, 1000])
def test_added_pairs(spark, rows, block):
    """However a hot user's rows are cut, new pairs are those of all rows less those of old rows."""
    def distinct(parts):
        frame = spark.createDataFrame([r for part in parts for r in part], SCHEMA)
        rated = frame.where("user_id IS NOT NULL AND item_id IS NOT NULL AND rating IS NOT NULL")
        return rated.select("user_id", "item_id", "rating").distinct()

    def sums(frame):
        return {(r["item_id"], r["other_id"]): [r[name] for name in deltas.ADDED] for r in frame.collect()}

    old, everything = distinct(rows[:2]), distinct(rows)
    fresh = deltas.fresh_rows(distinct(rows[2:]), old)
    none = old.limit(0)
    before, after = sums(deltas.added_pairs(old, none)), sums(deltas.added_pairs(everything, none))
    added = sums(deltas.added_pairs(fresh, old, block_items=block))
    zero = [0] * len(deltas.ADDED)
    for pair, total in after.items():
        assert total == [x + y for x, y in zip(before.get(pair, zero), added.get(pair, zero))]
    assert before.keys() | added.keys() == after.keys()


def test_a_batch_reads_the_parts_of_its_users(spark, rows):
    root = work_folder(spark, "parts")
    algorithm = algorithms.Algorithm("CH/1", "AL-1", "jaccard")
    incremental.update(spark, root, algorithm, spark.createDataFrame(rows[0], SCHEMA), 0)
    incremental.compact(spark, root)
    one = [row[0] for row in spark.range(5, 6).select(F.col("id").alias("user_id")).select(incremental.ROWS.bucket()).collect()]
    all_files = batches.read(spark, f"{root}/pairs", incremental.ROWS).inputFiles()
    some = batches.read(spark, f"{root}/pairs", incremental.ROWS, one)
    touched = {row[0] for row in some.select(F.input_file_name()).distinct().collect()}
    assert len(touched) == 1 and len(all_files) > 10
    users = {row["user_id"] for row in some.collect()}
    assert 5 in users and users < {row["user_id"] for row in batches.read(spark, f"{root}/pairs", incremental.ROWS).collect()}


def test_pairs_of_old_rows_are_not_made_again(spark):
    """One new row of a user with many: as many pairs as old rows, in the plan's own counts."""
    old = spark.range(300).selectExpr("1L AS user_id", "id AS item_id", "CAST(NULL AS DOUBLE) AS rating")
    fresh = spark.range(1).selectExpr("1L AS user_id", "1000L AS item_id", "CAST(NULL AS DOUBLE) AS rating")
    added = deltas.added_pairs(fresh, old)
    assert added.agg(F.sum("n"), F.count("*")).first() == (300, 300)


def test_factorisations_are_refused(spark, rows):
    algorithm = algorithms.Algorithm("CH/1", "AL-1", "als")
    with pytest.raises(ValueError, match="not kept up"):
        incremental.update(spark, "/nowhere", algorithm, spark.createDataFrame(rows[0], SCHEMA), 0)
