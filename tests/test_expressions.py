from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from kindred.functions import keys, text, times
from kindred.operators import catalog, content, dashboard, factorize, items, jobs


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("number", "expected"),
    [(0, "000000"), (398, "000398"), (999999, "999999"), (3084704, "3084704")],
)
def test_padding_keeps_long_numbers(spark, number, expected):
    assert value(spark, keys.padded(F.lit(number))) == expected


def test_keys(spark):
    result = keys.result_key(F.lit("CH-1"), F.lit("AL-1"), F.lit(7), F.lit("000002"))
    assert value(spark, result) == "ch-1:al-1:7:000002"
    assert value(spark, keys.algo_key(F.lit("ch-1"), F.lit("al-1"))) == "CH-1:AL-1"
    assert value(spark, keys.part(F.lit("a:b"), 1)) == "b"
    assert value(spark, keys.part(F.lit("a:b"), 2)) is None
    made = keys.timed_id(keys.CHANNEL_PREFIX, F.lit(1447000000000))
    assert value(spark, made) == "CH-" + format(1447000000000, "X")
    assert value(spark, keys.id_millis(made)) == 1447000000000


def test_text(spark):
    assert value(spark, text.action_list(F.lit(" view , buy"))) == ["view", "buy"]
    cell = text.actions_to_json(F.array(F.lit("view"), F.lit("buy")))
    assert value(spark, cell) == '["view","buy"]'
    assert value(spark, text.actions_text(text.actions_from_json(cell))) == "view,buy"
    assert value(spark, text.plain_number(F.lit(4.0))) == "4"
    assert value(spark, text.plain_number(F.lit(2.5))) == "2.5"
    assert value(spark, text.name_matches(F.lit("My Shop"), "^MY s")) is True


@pytest.mark.parametrize(
    ("given", "expected"),
    [("12 cm", 12.0), (" -3.5e2x", -350.0), (".5", 0.5), ("7.", 7.0), ("cm", None), ("", None)],
)
def test_leading_number(spark, given, expected):
    assert value(spark, text.leading_number(F.lit(given))) == expected


@pytest.mark.parametrize(
    ("millis", "expected"),
    [(59_999, "59 secs"), (60_000, "1 min"), (3_600_000, "60 min"), (3_600_001, "1 hrs"),
     (9_000_000, "2 hrs")],
)
def test_humanised(spark, millis, expected):
    assert value(spark, times.humanised(F.lit(millis))) == expected


def test_times(spark):
    assert value(spark, times.long_day(F.lit(1456790400000))) == "1 March, 2016"
    iso = times.iso_text(times.parsed(F.lit("2024-1-2 3:4:5")))
    assert value(spark, iso) == "2024-01-02T03:04:05"
    assert value(spark, times.epoch_seconds(times.parsed(F.lit("1970-01-02 00:00:00")))) == 86400
    assert value(spark, times.percent(F.lit(2), F.lit(3))) == 66
    assert value(spark, times.percent(F.lit(0), F.lit(0))) is None


@pytest.mark.parametrize("size", [1, 2, 3, 10, 501, 4000])
def test_exact_medians(spark, size):
    random.seed(size)
    numbers = [random.choice([random.random(), random.randint(0, 3)]) for _ in range(size)]
    others = [random.gauss(0, 1) for _ in range(size)]
    frame = spark.createDataFrame(
        [("CH-1", float(a), float(b)) for a, b in zip(numbers, others)] + [("CH-1", None, None)],
        "channel_id string, a double, b double",
    )
    row = content.medians(frame, ["a", "b"]).first()
    assert (row["a"], row["b"]) == (statistics.median(numbers), statistics.median(others))


def test_imputing(spark):
    frame = spark.createDataFrame(
        [
            ("CH-1", 1, 2.0), ("CH-1", 2, 10.0), ("CH-1", 3, 3.0), ("CH-1", 4, None),
            ("CH-2", 5, 8.0),
        ],
        "channel_id string, item_id bigint, size double",
    )
    attributes = {"size": ("Size", items.NUMERIC)}
    for policy, expected in {"zero": 0.0, "mean": 5.0, "median": 3.0}.items():
        filled = content.impute(frame, attributes, policy).where("item_id = 4").first()
        assert filled["size"] == expected
    with pytest.raises(ValueError):
        content.impute(frame, attributes, "mode")


def test_declared_attributes(spark):
    table = spark.createDataFrame(
        [("CH-1", "size", "Size", "numeric"), ("CH-2", "brand", "Brand", "categorical")],
        "channel_id string, key string, name string, type string",
    )
    assert items.declared_attributes(table, "CH-1") == {"size": ("Size", "numeric")}


def test_metadata_validation(spark):
    frame = spark.createDataFrame(
        [("CH-1", 1, 1, {"size": "4 cm"}), ("CH-1", 1, 2, {"size": "x"}),
         ("CH-1", 2, 1, {"size": "1", "colour": "red"})],
        "channel_id string, item_id bigint, seq bigint, attributes map<string,string>",
    )
    attributes = {"size": ("Size", items.NUMERIC)}
    declared = items.declaration(spark, "CH-1", attributes)
    typed = items.accepted(frame, declared, attributes)
    newest = items.latest(typed, attributes).collect()
    assert [(r["item_id"], r["size"]) for r in newest] == [(1, None)]
    refused = items.rejected(frame, declared).collect()
    assert [(r["item_id"], r["undeclared"]) for r in refused] == [(2, "colour")]


def test_filled_days(spark):
    counts = spark.createDataFrame(
        [("CH-1", "2024-02-28", 2), ("CH-1", "2024-03-01", 1)],
        "channel_id string, day string, hits bigint",
    )
    filled = dashboard.fill_days(counts).orderBy("day").collect()
    assert [(r["day"], r["hits"]) for r in filled] == [
        ("2024-02-28", 2), ("2024-02-29", 0), ("2024-03-01", 1),
    ]


def test_approximate_totals_are_close(spark):
    rows = spark.range(20000).select(
        F.lit("CH-1").alias("channel_id"), (F.col("id") % 5000).alias("user_id"),
        (F.col("id") % 300).alias("item_id"),
    )
    exact, near = dashboard.totals(rows).first(), dashboard.totals(rows, exact=False).first()
    assert (exact["hits"], exact["distinct_users"], exact["distinct_items"]) == (20000, 5000, 300)
    assert abs(near["distinct_users"] - 5000) < 250 and abs(near["distinct_items"] - 300) < 15


def test_catalog(spark):
    clients = spark.createDataFrame(
        [("CL-1", "Shop", 0), ("CL-2", "Blog", 0)],
        "client_id string, name string, created_ms bigint",
    )
    channels = spark.createDataFrame(
        [("CH-1", "CL-2", "a", 1), ("CH-2", "CL-2", "b", 2)],
        "channel_id string, client_id string, name string, created_ms bigint",
    )
    listed = catalog.clients_with_channels(clients, channels).collect()
    assert [(r["client_id"], r["channel_id"]) for r in listed] == [
        ("CL-2", "CH-1"), ("CL-2", "CH-2"), ("CL-1", None),
    ]
    newest = catalog.channels_of(channels, "CL-2").collect()
    assert [r["channel_id"] for r in newest] == ["CH-2", "CH-1"]
    assert catalog.search_clients(clients, None).count() == 2


def test_algorithm_state(spark):
    runs = spark.createDataFrame(
        [("CH-1", "AL-1", 1, 0, 5_000, "success"), ("CH-1", "AL-1", 2, 6_000, 9_000, "failure"),
         ("CH-1", "AL-2", 3, 0, 9_000, "failure")],
        "channel_id string, algo_id string, run_id bigint, start_ms bigint, end_ms bigint, "
        "outcome string",
    )
    state = {r["algo_id"]: r for r in jobs.algorithm_state(runs, F.lit(125_000)).collect()}
    first, second = state["AL-1"], state["AL-2"]
    assert (first["last_outcome"], first["version"], first["took"], first["ago"]) == (
        "failure", "000001", "5 secs", "2 min",
    )
    assert (second["last_outcome"], second["version"]) == ("failure", None)
    assert second["last_run_ms"] is None
    # Runs that carry their version say which one is served, whatever their number.
    versions = F.when(F.col("run_id") == 1, "000007").otherwise("000008")
    state = jobs.algorithm_state(runs.withColumn("version", versions)).where("algo_id = 'AL-1'")
    assert state.first()["version"] == "000007"


def test_job_history(spark):
    runs = spark.createDataFrame(
        [
            ("CH-1", "AL-1", 1, 0, 5_000, "success", "ok"),
            ("CH-1", "AL-1", 2, 6_000, 9_999, None, ""),
            ("CH-1", "AL-2", 3, 0, 9_000, "failure", ""),
        ],
        "channel_id string, algo_id string, run_id bigint, start_ms bigint, end_ms bigint, "
        "outcome string, output string",
    )
    stored = jobs.runs_from_cells(jobs.history_cells(runs))
    for rows in (runs, stored):
        shown = jobs.history_of(rows, "CH-1", "AL-1").collect()
        assert [r["rank"] for r in shown] == [1, 2]
    assert [(r["job"], r["outcome"], r["seconds"], r["took"]) for r in shown] == [
        ("2", "NA", 3, "3 secs"), ("1", "success", 5, "5 secs"),
    ]


def test_factorisation(spark, ratings):
    predicted = factorize.predictions(ratings)
    observed = {(r["user_id"], r["item_id"]): r["rating"] for r in ratings.collect()}
    scored = {(r["user_id"], r["item_id"]): r["score"] for r in predicted.collect()}
    assert scored.keys() == observed.keys()
    assert all(abs(scored[pair] - rating) < 1 for pair, rating in observed.items())
    wide = ratings.withColumn("user_id", F.col("user_id") + 2**40)
    far = {(r["user_id"] - 2**40, r["item_id"]) for r in factorize.predictions(wide).collect()}
    assert far == observed.keys()


def test_dense_ids(spark):
    rows = spark.range(0, 10**12, 10**9).select(F.col("id").alias("user_id")).repartition(7)
    numbers = factorize.dense_ids(rows.unionAll(rows), "user_id").collect()
    assert sorted(r["user_number"] for r in numbers) == list(range(1000))
    assert len({r["user_id"] for r in numbers}) == 1000
