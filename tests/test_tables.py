from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from kindred.operators import ranking
from kindred.plans import algorithms
from kindred.session import work_folder
from kindred.sources import cells, tables


def test_parameters():
    assert algorithms.parse_parameters("actions=a,b#algoId=AL-1") == {
        "actions": ["a", "b"], "algoId": "AL-1",
    }
    assert algorithms.parse_parameters("actions= #algoId=AL-1") == {"algoId": "AL-1"}


def test_unknown_algorithm():
    with pytest.raises(ValueError, match="unknown base"):
        algorithms.Algorithm("CH-1", "AL-1", "euclid")


def test_versions_move_on_success_only(spark, baskets):
    root = work_folder(spark, "versions")
    good = algorithms.Algorithm("CH-1", "AL-1", "jaccard")
    # There are no ratings, so this run fails.
    bad = algorithms.Algorithm("CH-1", "AL-1", "als")
    assert algorithms.run(spark, root, baskets, good) == "000001"
    with pytest.raises(AnalysisException):
        algorithms.run(spark, root, baskets, bad)
    runs = tables.read_runs(spark, root).orderBy("end_ms", "outcome").collect()
    assert [(r["version"], r["outcome"]) for r in runs] == [
        ("000001", "success"), ("000002", "failure"),
    ]
    assert tables.current_results(spark, root, tables.SIMILARITY).first()["version"] == "000001"
    assert algorithms.run(spark, root, baskets, good) == "000002"
    current = tables.current_results(spark, root, tables.SIMILARITY)
    assert current.select("version").distinct().count() == 1
    assert current.count() == 6
    best = ranking.similar_to(current, 10, 1).first()
    assert (best["other_id"], best["score"]) == (20, 500)


def test_version_order_is_numeric(spark):
    root = work_folder(spark, "runs")
    for version in ("999999", "1000000"):
        tables.record_run(
            spark, root, channel_id="CH-1", algo_id="AL-1", version=version, outcome="success"
        )
    assert tables.current_versions(tables.read_runs(spark, root)).first()["version"] == "1000000"
    assert tables.next_version(spark, root, "CH-1", "AL-1") == "1000001"


def test_served_recommendations(spark, ratings):
    root = work_folder(spark, "served")
    timed = ratings.withColumn("time", F.lit("2024-01-01").cast("timestamp"))
    tables.append_history(timed, root, F.lit(1))
    for base in ("jaccard", "als", "alsimplicit"):
        algorithm = algorithms.Algorithm("CH-1", f"AL-{base}", base)
        algorithms.run(spark, root, ratings, algorithm)
        served = algorithms.serve(spark, root, algorithm, 2)
        assert served.columns == ["channel_id", "user_id", "item_id", "score", "rank"]
        assert served.groupBy("user_id").count().agg(F.max("count")).first()[0] == 2
        assert served.select("user_id").distinct().count() == 4
    stored = tables.current_results(spark, root, tables.RECOMMENDATIONS)
    first = cells.recommendation_cells(stored.where("algo_id = 'AL-als'")).first()
    assert first["rowkey"].startswith("ch-1:al-als:") and first["family"] == "r"


def test_point_reads_reach_the_scan(spark, baskets):
    root = work_folder(spark, "pruned")
    algorithms.run(spark, root, baskets, algorithms.Algorithm("CH-1", "AL-1", "jaccard"))
    results = tables.read_results(spark, root, tables.SIMILARITY)
    wanted = results.where("channel_id = 'CH-1' AND version = '000001' AND item_id = 10")
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(channel_id" in plan
    assert "EqualTo(item_id,10)" in plan
