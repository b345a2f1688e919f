"""Physical plans keep the shape large data needs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from kindred.operators import content, cooccurrence, filters, similarity
from kindred.plans import similarity_queries, table_queries, views
from kindred.sources import tables

SF_DIR = "/root/testdata/sf0.001"
# These write tables or fit models before they return.
EAGER = ("als", "stream", "bulk", "interactions_", "similarity_current", "served")
NAMES = [*similarity_queries.QUERIES, *table_queries.QUERIES]
LAZY = sorted(name for name in NAMES if not name.startswith(EAGER))


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_python_and_no_cartesian_product(spark, name):
    text = plan(entry_points.queries()[name](spark, SF_DIR))
    assert "Python" not in text and "InPandas" not in text
    assert "CartesianProduct" not in text


def test_filters_and_columns_reach_the_scan(spark):
    rows = filters.of_actions(views.baskets(spark, SF_DIR), ["A", "R"])
    text = plan(similarity.similarity(rows, "jaccard", by=()))
    assert "In(l_returnflag, [A,R])" in text
    assert "l_extendedprice" not in text


@pytest.fixture
def broadcast_limit(spark):
    """Sets the size below which Spark broadcasts a join side."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    yield lambda size: spark.conf.set(threshold, size)
    spark.conf.set(threshold, before)


@pytest.fixture
def no_broadcast(broadcast_limit):
    """Plans as they are when no side is small."""
    broadcast_limit("-1")


def test_self_join_writes_its_shuffle_once(spark, no_broadcast):
    pairs = cooccurrence.user_items(views.baskets(spark, SF_DIR), by=())
    frame = cooccurrence.pair_counts(pairs, by=())
    frame.collect()
    final = plan(frame).split("== Initial Plan ==")[0]
    tiles = [
        line
        for line in final.splitlines()
        if "hashpartitioning(user_id" in line and "low" in line
    ]
    reused = ["ReusedExchange" in line for line in tiles]
    assert sorted(reused) == [False, True]


def test_pairs_are_shuffled_once(spark, no_broadcast):
    """Counts join the rows before they are paired, so one exchange follows the self-join."""
    for base in ("jaccard", "loglikelihood"):
        text = plan(similarity.similarity(views.baskets(spark, SF_DIR), base, by=()))
        after = text.split("SortMergeJoin")[0]
        assert after.count("Exchange hashpartitioning") == 1
        assert "hashpartitioning(item_id" in after and "other_id" in after


def test_contributions_are_summed_where_they_are_made(spark, no_broadcast):
    """Only the best of each user are shuffled, neither contributions nor the sums of them."""
    for name in ("user_recs_mixed", "served_recommendations"):
        text = plan(entry_points.queries()[name](spark, SF_DIR))
        by_user = [
            line for line in text.splitlines()
            if "Exchange hashpartitioning(" in line and "user_id" in line
        ]
        assert by_user and not any("other_id" in line for line in by_user)
        after = text.split("Generate inline(similar")[0]
        assert after.count("Exchange") == 1 and "WindowGroupLimit" in after.split("Exchange")[1]


def test_building_starts_no_job(spark):
    """Filling in values and reading served versions only describe their work."""
    rows = views.items(spark, SF_DIR)
    ids = set(spark.sparkContext.statusTracker().getJobIdsForGroup())
    for policy in ("zero", "mean", "median"):
        content.impute(rows, views.ITEM_ATTRIBUTES, policy)
    tables.current_results(spark, "/none", tables.SIMILARITY)
    assert set(spark.sparkContext.statusTracker().getJobIdsForGroup()) == ids


@pytest.mark.parametrize("name", ["similar_items_jaccard", "llr_pairs", "user_recs_mixed"])
def test_nothing_is_broadcast_unless_small(spark, no_broadcast, name):
    frame = entry_points.queries()[name](spark, SF_DIR)
    frame.collect()
    assert "Broadcast" not in plan(frame)


def test_measured_sizes_decide_at_run_time(spark, broadcast_limit):
    """Item counts are broadcast once measured, although the input is too large to be sure
    beforehand, and without hot users their join falls away."""
    broadcast_limit("100000")
    baskets = views.baskets(spark, "/root/testdata/sf0.01")
    frame = similarity.similarity(baskets, "jaccard", by=())
    assert "Broadcast" not in plan(frame)
    frame.collect()
    final = plan(frame).split("== Initial Plan ==")[0]
    assert final.count("BroadcastHashJoin") == 1
    assert final.count("SortMergeJoin") == 1 and "LeftOuter" not in final


def test_a_hot_user_is_found_small_and_cut(spark, broadcast_limit):
    """The list of hot users is broadcast and the rows stay with the tasks that made them."""
    broadcast_limit("150000")
    baskets = views.baskets(spark, "/root/testdata/sf0.01")
    one_third = F.when(F.col("user_id") % 3 == 0, -1).otherwise(F.col("user_id"))
    pairs = cooccurrence.user_items(baskets.withColumn("user_id", one_third), by=())
    frame = cooccurrence.same_user_pairs(pairs, by=())
    found = frame.where("user_id = -1").count()
    items = pairs.where("user_id = -1").count()
    assert found == items * (items - 1) // 2
    counts = cooccurrence.pair_counts(pairs, by=())
    counts.collect()
    final = plan(counts).split("== Initial Plan ==")[0]
    assert "LeftOuter, BuildRight" in final and "AQEShuffleRead local" in final


def test_top_k_cuts_groups_before_the_shuffle(spark):
    text = plan(entry_points.queries()["similar_items_jaccard"](spark, SF_DIR))
    assert "WindowGroupLimit" in text
