"""Live windows with late rows, and streams without repeated messages."""

from __future__ import annotations

import pytest

from kindred.plans import requests
from kindred.session import work_folder
from kindred.sources import parsing, readers, tables
from kindred.streaming import ingest, live


def parsed(spark, *times, channel="CH-1"):
    lines = [(f"CL-1,{channel},1,{n},2024-01-01 {time},view",) for n, time in enumerate(times)]
    return parsing.parse_messages(spark.createDataFrame([*lines, ("bad",)], "value string"))


def found(spark, root):
    rows = live.counts(spark, root, "S").orderBy("channel_id", "window_start").collect()
    return [(r["channel_id"], r["window_start"].hour, r["hits"], r["late"], r["closed"]) for r in rows]


def test_windows_close(spark):
    root = work_folder(spark, "live")
    assert found(spark, root) == []
    live.count_batch(parsed(spark, "10:00:00", "10:30:00", "11:05:00"), "S", 0, root)
    # The watermark is 10:55: the first window is open still.
    assert found(spark, root) == [("CH-1", 10, 2, 0, False), ("CH-1", 11, 1, 0, False)]
    live.count_batch(parsed(spark, "10:59:59", "11:15:00"), "S", 1, root)
    assert found(spark, root) == [("CH-1", 10, 3, 0, True), ("CH-1", 11, 2, 0, False)]
    late = parsed(spark, "10:01:00", "09:00:00", "12:00:00")
    live.count_batch(late, "S", 2, root)
    want = [("CH-1", 9, 0, 1, True), ("CH-1", 10, 3, 1, True), ("CH-1", 11, 2, 0, False), ("CH-1", 12, 1, 0, False)]
    assert found(spark, root) == want
    # A batch that is repeated, or comes after a compaction, counts once against the same watermark.
    live.count_batch(late, "S", 2, root)
    assert found(spark, root) == want
    live.compact(spark, root)
    live.count_batch(parsed(spark, "10:59:59", "11:15:00"), "S", 1, root)
    assert found(spark, root) == want
    # Another channel goes by the stream's watermark; a batch without good rows changes nothing.
    live.count_batch(parsed(spark, "10:00:00", channel="CH-2"), "S", 3, root)
    live.count_batch(parsed(spark), "S", 4, root)
    assert found(spark, root) == [*want, ("CH-2", 10, 0, 1, True)]


LINES = ["CL-1,CH-1,1,10,2024-01-01 00:00:01,view", "CL-1,CH-1,1,10,2024-1-1 0:00:01,view", "bad", "CL-1,CH-1,1,10,2024-01-01 00:00:01,buy"]


def lines(spark, texts):
    return spark.createDataFrame([(text,) for text in texts], "value string")


def test_a_stream_without_repeats(spark):
    """Across batches and restarts; the same values written otherwise are the same."""
    root = work_folder(spark, "once")
    for count, texts in enumerate((LINES[:3], LINES, [*LINES, "worse", "worse"])):
        lines(spark, texts).coalesce(1).write.mode("append").text(f"{root}/messages")
        source = readers.message_files(spark, f"{root}/messages", files_per_batch=1)
        query = ingest.ingest(source, root, f"{root}/checkpoint", available_now=True, dedup_within="1 hour")
        query.awaitTermination()
        assert tables.read_interactions(spark, root).count() == min(count + 1, 2)
        assert tables.read_rejects(spark, root).count() == 1 + (count == 2)


def test_an_upload_without_repeats(spark):
    root, path = work_folder(spark, "upload"), work_folder(spark, "file")
    lines(spark, ["1,10,2024-01-01 00:00:01,view"] * 3 + ["2,10,2024-01-01 00:00:01,view", "x", "x", "y"]).write.text(path)
    for dedup, rows, bad in ((True, 2, 2), (False, 4, 3)):
        requests.load_upload(spark, root, path, "CL-1", "CH-1", "U1", 1, dedup=dedup)
        assert tables.read_interactions(spark, root).count() == rows
        assert tables.read_rejects(spark, root).count() == bad


def test_a_stream_needs_a_time(spark):
    folder = work_folder(spark, "some")
    lines(spark, LINES).write.text(folder)
    with pytest.raises(ValueError, match="time within"):
        parsing.without_repeats(parsing.parse_messages(readers.message_files(spark, folder)))
