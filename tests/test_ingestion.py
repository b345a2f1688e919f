from __future__ import annotations

import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred import schemas
from kindred.operators import history, similarity
from kindred.session import work_folder
from kindred.sources import parsing, readers, tables
from kindred.streaming import ingest

LINES = [
    "1,10,2024-01-01 00:00:01,view",
    "1,10,2024-01-01 00:00:01,rating,4",
    "2,20,2024-1-2 3:4:5,rating,2.5",
    "2,30,2024-01-02 00:00:00,rating",
    "3,10,2024-01-02 00:00:00,view,5,6",
    "4,10,2024-01-02 00:00:00,buy,7",
]
BROKEN = {
    "x,10,2024-01-01 00:00:01,view": "user is not a number",
    "1,y,2024-01-01 00:00:01,view": "item is not a number",
    "1,10,2024-01-01 00:00:01": "too few fields",
    "1,10,yesterday,view": "time is not a time",
    "1,10,2024-13-01 00:00:01,view": "time is not a time",
    "1,10,2024-01-01 00:00:01,rating,many": "rating is not a number",
    "": "too few fields",
}


def lines(spark, texts):
    return spark.createDataFrame([(text,) for text in texts], "value string")


def test_bulk_lines(spark):
    parsed = parsing.parse_bulk(lines(spark, [*LINES, *BROKEN]), "CL-1", "CH-1", "F1")
    good = parsing.accepted(parsed).orderBy("user_id", "item_id", "action").collect()
    shown = [(r["user_id"], r["item_id"], str(r["time"]), r["action"], r["rating"]) for r in good]
    assert shown == [
        (1, 10, "2024-01-01 00:00:01", "rating", 4.0),
        (1, 10, "2024-01-01 00:00:01", "view", None),
        (2, 20, "2024-01-02 03:04:05", "rating", 2.5),
        (2, 30, "2024-01-02 00:00:00", "rating", None),
        (3, 10, "2024-01-02 00:00:00", "view", None),
        (4, 10, "2024-01-02 00:00:00", "buy", 7.0),
    ]
    assert {(r["client_id"], r["channel_id"], r["ingestion"], r["bulkfile"]) for r in good} == {
        ("CL-1", "CH-1", "bulk", "F1")
    }
    rejects = parsing.rejected(parsed).collect()
    assert {r["raw"]: r["reason"] for r in rejects} == BROKEN


def test_stream_messages_parse_like_bulk_lines(spark):
    texts = [line for line in LINES if line.count(",") < 5]
    bulk = parsing.parse_bulk(lines(spark, texts), "CL-1", "CH-1", "F1")
    messages = parsing.parse_messages(lines(spark, [f"CL-1,CH-1,{t}" for t in texts]))
    shared = ["client_id", "channel_id", "user_id", "item_id", "time", "action", "rating"]
    ours, theirs = parsing.accepted(messages).select(shared), parsing.accepted(bulk).select(shared)
    assert ours.exceptAll(theirs).isEmpty() and theirs.exceptAll(ours).isEmpty()


def test_messages_survive_encoding(spark):
    parsed = parsing.accepted(parsing.parse_bulk(lines(spark, LINES), "CL-1", "CH-1", "F1"))
    again = parsing.accepted(parsing.parse_messages(parsing.encode_messages(parsed)))
    shared = ["client_id", "channel_id", "user_id", "item_id", "time", "action"]
    assert again.select(shared).exceptAll(parsed.select(shared)).isEmpty()
    assert again.count() == len(LINES)


def test_bulk_tables(spark):
    root = work_folder(spark, "bulk")
    assert tables.read_interactions(spark, root).count() == 0
    rows = parsing.accepted(parsing.parse_bulk(lines(spark, LINES), "CL-1", "CH-1", "F1"))
    for load in (1, 2):
        tables.append_interactions(rows, root)
        tables.append_history(rows, root, F.lit(load))
    assert tables.read_interactions(spark, root).count() == 2 * len(LINES)
    past = tables.read_history(spark, root)
    assert past.count() == 5
    same_second = past.where("user_id = 1").first()
    assert (same_second["action"], same_second["ingest_seq"]) == ("view", 2)


def test_history_responses(spark):
    rows = parsing.accepted(parsing.parse_bulk(lines(spark, LINES), "CL-1", "CH-1", "F1"))
    past = history.from_interactions(rows, F.lit(1))
    shown = {
        (r["user_id"], r["item_id"]): (r["rating"], r["action"], r["time"])
        for r in history.responses(history.latest(past)).collect()
    }
    assert shown[2, 20] == (2.5, None, "2024-01-02 03:04:05")
    assert shown[2, 30] == (None, "rating", "2024-01-02 00:00:00")
    assert shown[4, 10] == (None, "buy:7", "2024-01-02 00:00:00")
    assert [r["item_id"] for r in history.user_history(past, "CH-1", 2).collect()] == [20, 30]


def test_a_repeated_batch_leaves_no_duplicates(spark):
    root = work_folder(spark, "replayed")
    batches = [LINES[:3] + list(BROKEN), LINES[3:4], []]
    for batch_id, texts in enumerate(batches):
        parsed = parsing.parse_messages(lines(spark, [f"CL-1,CH-1,{t}" for t in texts]))
        for _ in range(2):
            ingest.write_batch(parsed, "S1", batch_id, root)
    assert tables.read_interactions(spark, root).count() == 4
    assert tables.read_history(spark, root).count() == 3
    assert tables.read_rejects(spark, root).count() == len(BROKEN)


def test_columns_are_the_canonical_ones(spark):
    parsed = parsing.parse_messages(lines(spark, LINES))
    for frame, schema in (
        (parsing.accepted(parsed), schemas.INTERACTIONS),
        (parsing.rejected(parsed), schemas.REJECTS),
        (history.from_interactions(parsing.accepted(parsed), F.lit(1)), schemas.USER_HISTORY),
        (history.to_cells(history.from_interactions(parsed, F.lit(1))), schemas.CELLS),
    ):
        expected = T.StructType.fromDDL(schema)
        assert [(f.name, f.dataType) for f in frame.schema] == [
            (f.name, f.dataType) for f in expected
        ]


def test_a_restarted_stream_goes_on_where_it_was(spark):
    root = work_folder(spark, "restarted")
    for count, texts in enumerate((LINES[:2], LINES[2:4]), start=1):
        messages = lines(spark, [f"CL-1,CH-1,{t}" for t in texts])
        messages.write.mode("append").text(f"{root}/messages")
        source = readers.message_files(spark, f"{root}/messages", files_per_batch=1)
        query = ingest.ingest(source, root, f"{root}/checkpoint", available_now=True)
        query.awaitTermination()
        assert tables.read_interactions(spark, root).count() == 2 * count


def test_streams_keep_each_others_rows(spark):
    """A new checkpoint on the same root starts counting batches again."""
    root = work_folder(spark, "streams")
    for count, text in enumerate(LINES[:3], start=1):
        lines(spark, [f"CL-1,CH-1,{text}", "bad"]).write.text(f"{root}/messages-{count}")
        source = readers.message_files(spark, f"{root}/messages-{count}")
        checkpoint = f"{root}/checkpoint-{count}"
        ingest.ingest(source, root, checkpoint, available_now=True).awaitTermination()
        assert tables.read_interactions(spark, root).count() == count
        assert tables.read_rejects(spark, root).count() == count


def test_the_later_write_wins(spark):
    """Bulk loads and streams are on one scale of milliseconds."""
    root, now = work_folder(spark, "order"), int(time.time() * 1000)

    def bulk(action, at):
        line = f"1,10,2024-01-01 00:00:01,{action}"
        rows = parsing.accepted(parsing.parse_bulk(lines(spark, [line]), "CL-1", "CH-1", "F1"))
        tables.append_history(rows, root, F.lit(at))

    def action():
        return tables.read_history(spark, root).first()["action"]

    bulk("zoom", now - 60_000)
    lines(spark, ["CL-1,CH-1,1,10,2024-01-01 00:00:01,view"]).write.text(f"{root}/messages")
    source = readers.message_files(spark, f"{root}/messages")
    ingest.ingest(source, root, f"{root}/checkpoint", available_now=True).awaitTermination()
    assert action() == "view"
    bulk("buy", now + 3_600_000)
    assert action() == "buy"


NO_RATINGS = ("NaN", "Infinity", "-inf", "1e300", "4d", "4f", "0x1", "", " ", "9" * 16)


def test_ratings_are_finite_plain_numbers(spark):
    texts = [f"1,{item},2024-01-01 00:00:01,rating,{rating}" for item, rating in enumerate(NO_RATINGS)]
    texts += [f"{user},{item},2024-01-01 00:00:01,rating,{user + item}.5" for user in (1, 2) for item in (90, 91)]
    parsed = parsing.parse_bulk(lines(spark, texts), "CL-1", "CH-1", "F1")
    refused = parsing.rejected(parsed).collect()
    assert len(refused) == len(NO_RATINGS)
    assert {r["reason"] for r in refused} == {"rating is not a number"}
    rows = parsing.accepted(parsed)
    assert similarity.similarity(rows, "pearson").count() == 1
    past = history.latest(history.from_interactions(rows, F.lit(1)))
    assert history.responses(past).where("rating = 91.5").count() == 1
    assert history.from_cells(history.to_cells(past)).where("rating = 91.5").count() == 1


def test_odd_stored_ratings_do_not_stop_reading(spark):
    past = spark.createDataFrame(
        [("CH-1", 1, 10, "rating", rating) for rating in (float("nan"), float("inf"), 1e300)],
        "channel_id string, user_id bigint, item_id bigint, action string, rating double",
    ).withColumn("time", F.lit("2024-01-01").cast("timestamp"))
    assert history.responses(past).count() == 3
    assert history.to_cells(past).select("value").distinct().count() == 3


def test_cells_keep_colons_in_actions(spark):
    past = spark.createDataFrame(
        [("add:cart", None), ("rating", 4.0), ("rating", 2.5), ("rating:x", None), ("view", None)],
        "action string, rating double",
    ).selectExpr(
        "'CH-1' AS channel_id", "1L AS user_id", "2L AS item_id", "action", "rating",
        "timestamp'2024-01-01' AS time",
    )
    back = history.from_cells(history.to_cells(past)).select("action", "rating")
    assert back.exceptAll(past.select("action", "rating")).isEmpty()
    assert back.count() == 5


def test_kafka_needs_its_connector(spark):
    with pytest.raises(AnalysisException, match="(?i)kafka"):
        readers.kafka_messages(spark, "localhost:9092", "interactions")


def test_tables_keep_the_text_of_bad_lines_alone(spark, tmp_path):
    """What is kept for the tables holds no text of good lines, and folders need no sort of rows."""
    lines = spark.createDataFrame([("1,2,2024-01-01 00:00:00,view",), ("x,2,2024-01-01 00:00:00,view",)], "value string")
    kept = parsing.for_tables(parsing.parse_bulk(lines, "CL-1", "CH-1", "F1"))
    assert {(r["user_id"], r["raw"]) for r in kept.collect()} == {(1, None), (None, "x,2,2024-01-01 00:00:00,view")}
    # A sort by folder would put the rows of a file in an order of its own.
    rows = spark.range(0, 2000, 1, 1).selectExpr("id", "cast(id % 3 as string) AS channel_id")
    rows.write.partitionBy("channel_id").parquet(str(tmp_path / "rows"))
    assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) > 3
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 2000
