"""From an uploaded file to every request."""

from __future__ import annotations

import pytest

from kindred.operators import items, similarity
from kindred.plans import algorithms, requests
from kindred.session import work_folder
from kindred.sources import parsing, tables
from kindred.streaming import ingest

LINES = [
    "1,10,2024-01-01 00:00:01,view",
    "1,20,2024-01-01 00:00:02,rating,3",
    "1,30,2024-01-03 00:00:03,view",
    "2,10,2024-01-01 00:00:01,view",
    "2,20,2024-01-01 00:00:02,view",
    "3,20,2024-01-01 00:00:01,view",
    "3,30,2024-01-02 00:00:02,rating,5",
    "4,10,2024-01-02 00:00:02,view",
    "broken",
]
CHANNEL = "CH-1"


@pytest.fixture(scope="module")
def root(spark):
    folder = work_folder(spark, "requests")
    upload = work_folder(spark, "upload")
    spark.createDataFrame([(line,) for line in LINES], "value string").write.text(upload)
    requests.load_upload(spark, folder, upload, "CL-1", CHANNEL, "F1", 1)
    rejects = tables.read_rejects(spark, folder).collect()
    assert [(r["raw"], r["source"]) for r in rejects] == [("broken", "bulk")]
    rows = tables.read_interactions(spark, folder)
    for base in ("jaccard", "cosine", "als"):
        algorithm = algorithms.Algorithm(CHANNEL, f"AL-{base}", base)
        algorithms.run(spark, folder, rows, algorithm)
    return folder


def pairs(frame):
    return [(r[0], r[1]) for r in frame.collect()]


def test_similar_items(spark, root):
    best = requests.similar_items(spark, root, CHANNEL, "AL-jaccard", 20, 5)
    assert pairs(best) == [(30, 667), (10, 500)]
    assert requests.similar_items(spark, root, CHANNEL, "AL-none", 20, 5).isEmpty()


def test_comparison(spark, root):
    both = requests.compare_similar_items(spark, root, CHANNEL, ["AL-jaccard", "AL-cosine"], 10)
    assert {(r["algo_id"], r["item"], r["score"]) for r in both.collect()} == {
        ("AL-jaccard", 20, 500), ("AL-jaccard", 30, 250),
        ("AL-cosine", 20, 577), ("AL-cosine", 30, 318),
    }


def test_recommendations(spark, root):
    jaccard = algorithms.Algorithm(CHANNEL, "AL-jaccard", "jaccard")
    one = pairs(requests.recommendations(spark, root, jaccard, 2, 2))
    assert one == [(30, 917.0), (10, 500.0)]
    served = algorithms.serve(spark, root, jaccard, 2).where("user_id = 2").orderBy("rank")
    assert pairs(served.select("item_id", "score")) == one
    als = algorithms.Algorithm(CHANNEL, "AL-als", "als")
    stored = requests.recommendations(spark, root, als, 3, 5).collect()
    assert [r["item"] for r in stored] == [30]
    assert requests.recommendations(spark, root, jaccard, 99, 2).isEmpty()


def test_user_history(spark, root):
    shown = requests.user_history(spark, root, CHANNEL, 1).collect()
    assert [(r["item_id"], r["rating"], r["action"]) for r in shown] == [
        (30, None, "view"), (20, 3.0, None), (10, None, "view"),
    ]


def test_dashboards(spark, root):
    days = [("2024-01-01", 5), ("2024-01-02", 2), ("2024-01-03", 1)]
    chart = requests.ingestion_chart(spark, root, CHANNEL, "bulk")
    assert pairs(chart.select("day", "hits")) == days
    assert requests.ingestion_chart(spark, root, CHANNEL, "stream").isEmpty()
    assert pairs(requests.upload_chart(spark, root, "F1").select("day", "hits")) == days
    facets, totals = requests.channel_page(spark, root, CHANNEL)
    counted = {(r["facet"], r["value"]): r["hits"] for r in facets.collect()}
    assert counted["total", None] == 8 and counted["action", "rating"] == 2
    assert totals.first()["hits"] == 8
    browsed = requests.data_browser(spark, root, CHANNEL).collect()
    assert len(browsed) == 8 and browsed[0]["item_id"] == 30


def test_item_page(spark, root):
    attributes = {"size": ("Size", items.NUMERIC), "brand": ("Brand", items.CATEGORICAL)}
    submitted = spark.createDataFrame(
        [(CHANNEL, 10, 1, {"size": "4 cm", "brand": "A"}), (CHANNEL, 10, 2, {"size": "5"}),
         (CHANNEL, 10, 3, {"colour": "red"})],
        "channel_id string, item_id bigint, seq bigint, attributes map<string,string>",
    )
    tables.append_items(submitted, root, items.declaration(spark, CHANNEL, attributes))
    assert tables.read_item_rejects(spark, root).first()["undeclared"] == "colour"
    profile, days = requests.item_page(spark, root, CHANNEL, 10, attributes)
    assert [(r["label"], r["value"]) for r in profile.collect()] == [("Size", "5.0")]
    assert pairs(days.select("day", "hits")) == [("2024-01-01", 2), ("2024-01-02", 1)]
    fewer = {"brand": ("Brand", items.CATEGORICAL)}
    again, _ = requests.item_page(spark, root, CHANNEL, 10, fewer)
    assert again.count() == 0  # the same newest record, none of whose attributes are left
    assert tables.read_items(spark, root, CHANNEL, fewer).count() == 1


def test_catalog(spark, tmp_path):
    folder = work_folder(spark, "catalog")
    lines = str(tmp_path / "upload.csv")
    spark.createDataFrame([(line,) for line in LINES], "value string").write.text(lines)
    rows = {
        tables.CLIENTS: ([("CL-1", "One", 1), ("CL-2", "Two", 2)], "client_id, name, created_ms"),
        tables.CHANNELS: ([(CHANNEL, "CL-1", "Shop", 3)], "channel_id, client_id, name, created_ms"),
        tables.UPLOADS: (
            [(CHANNEL, "F1", 1, "a.csv", lines), (CHANNEL, "F2", 2, "b.csv", "none")],
            "channel_id, upload_id, upload_ms, oname, path",
        ),
        tables.ALGORITHMS: (
            [(CHANNEL, "AL-1", "jaccard", '["view","buy"]'), (CHANNEL, "AL-2", "contentbased", None)],
            "channel_id, algo_id, base, actions",
        ),
    }
    for name, (values, columns) in rows.items():
        tables.put_catalog(spark.createDataFrame(values, columns.split(", ")), folder, name)
    for _ in range(2):  # loading again replaces the upload's rows
        requests.load_registered(spark, folder, "F1")
    assert tables.read_interactions(spark, folder).count() == 8
    assert tables.read_rejects(spark, folder).count() == 1
    with pytest.raises(ValueError):
        requests.load_registered(spark, folder, "F9")
    assert [tuple(r[:4]) for r in requests.uploads(spark, folder, CHANNEL).collect()] == [
        (CHANNEL, "F2", 2, "b.csv"), (CHANNEL, "F1", 1, "a.csv"),
    ]
    assert [r["client_id"] for r in requests.clients(spark, folder, "o").collect()] == ["CL-1", "CL-2"]
    assert requests.channels(spark, folder, "CL-1").first()["channel_id"] == CHANNEL
    assert requests.owner(spark, folder, CHANNEL).first()["client_name"] == "One"
    assert requests.browser_total(spark, folder, CHANNEL).first()["total"] == 8
    found = algorithms.stored(spark, folder, CHANNEL, "AL-1")
    assert (found.base, found.actions) == ("jaccard", ("view", "buy"))
    assert algorithms.stored(spark, folder, CHANNEL, "AL-9") is None
    algorithms.run(spark, folder, tables.read_interactions(spark, folder), found)
    past = requests.job_history(spark, folder, CHANNEL, "AL-1").collect()
    assert [(r["outcome"], r["rank"]) for r in past] == [("success", 1)]

    declared = items.declaration(
        spark, CHANNEL, {"size": ("Size", items.NUMERIC), "brand": ("Brand", items.CATEGORICAL)}
    )
    tables.put_catalog(declared, folder, tables.ATTRIBUTES)
    submitted = spark.createDataFrame(
        [(CHANNEL, 1, 1, {"size": "4", "brand": "A"}), (CHANNEL, 2, 1, {"size": "4", "brand": "A"}),
         (CHANNEL, 3, 1, {"brand": "B"})],
        "channel_id string, item_id bigint, seq bigint, attributes map<string,string>",
    )
    tables.append_items(submitted, folder, declared)
    covered = {r["attribute"]: r["covered"] for r in requests.coverage(spark, folder, CHANNEL).collect()}
    assert covered == {"size": 2, "brand": 3}
    by_content = algorithms.stored(spark, folder, CHANNEL, "AL-2")
    assert algorithms.run(spark, folder, None, by_content) == "000001"
    assert pairs(requests.similar_items(spark, folder, CHANNEL, "AL-2", 1, 5)) == [(2, 1000), (3, 0)]
    with pytest.raises(ValueError):
        algorithms.serve(spark, folder, by_content, 5)


def test_no_algorithms_to_compare(spark, root):
    assert requests.compare_similar_items(spark, root, CHANNEL, [], 10).isEmpty()


def test_streamed_and_bulk_rows_count_together(spark, root):
    message = f"CL-1,{CHANNEL},4,30,2024-01-05 00:00:00,view"
    parsed = parsing.parse_messages(spark.createDataFrame([(message,)], "value string"))
    ingest.write_batch(parsed, "S1", 0, root)
    rows = tables.read_interactions(spark, root)
    assert rows.groupBy("ingestion").count().orderBy("ingestion").collect() == [
        ("bulk", 8), ("stream", 1),
    ]
    # User 4 now links items 10 and 30 as well.
    shared = similarity.similarity(rows, "cooccurrence").where("item_id = 10 AND other_id = 30")
    assert shared.first()["score"] == 2


def test_one_users_request_is_planned_when_it_runs(spark, root):
    """The range of the user's items reaches the scan as subqueries, and their measured size decides
    the join; building the request runs nothing over the history, and no join depends on a setting."""
    jaccard = algorithms.Algorithm(CHANNEL, "AL-jaccard", "jaccard")
    frame = requests.recommendations(spark, root, jaccard, 2, 2)
    scan = next(
        line
        for line in frame._jdf.queryExecution().executedPlan().toString().splitlines()
        if "FileScan" in line and "other_id" in line
    )
    assert "Subquery" in scan and "item_id" in scan.split("DataFilters")[1]
    assert [row[0] for row in frame.collect()] == [30, 10]
    assert "BroadcastHashJoin" in frame._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        again = requests.recommendations(spark, root, jaccard, 2, 2)
        assert [row[0] for row in again.collect()] == [30, 10]
        assert requests.recommendations(spark, root, jaccard, 12345, 2).collect() == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_requests_read_only_what_they_ask_for(spark, root):
    def scans(frame):
        text = frame._jdf.queryExecution().executedPlan().toString()
        return [line for line in text.splitlines() if "FileScan" in line]

    history = scans(requests.user_history(spark, root, CHANNEL, 1))
    assert history and all("EqualTo(user_id,1)" in line for line in history)
    assert all("PartitionFilters: [isnotnull(channel_id" in line for line in history)
    similar = scans(requests.similar_items(spark, root, CHANNEL, "AL-jaccard", 20, 5))
    assert similar and all("EqualTo(item_id,20)" in line for line in similar)
    assert all("version" in line.split("PartitionFilters")[1] for line in similar)
