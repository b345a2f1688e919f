"""Batches, compaction beside writers and readers, replays, replaced uploads, cleaning."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from kindred.operators import dashboard, rollups
from kindred.plans import requests
from kindred.session import work_folder
from kindred.sources import batches, files, parsing, readers, tables
from kindred.streaming import ingest

DAYS = [f"2024-{month:02}-{day:02} 00:00:0{day}" for month in (1, 2, 3) for day in (1, 2)]


def messages(spark, batch, channels=("CH-1", "CH/2")):
    texts = [f"CL-1,{channel},{batch % 3},{n},{day},view" for channel in channels for n, day in enumerate(DAYS)]
    return spark.createDataFrame([(text,) for text in [*texts, f"broken {batch}"]], "value string")


def write(spark, root, batch, source="S1", **more):
    ingest.write_batch(parsing.parse_messages(messages(spark, batch, **more)), source, batch, root)


def contents(spark, root):
    """All rows of the tables that a stream feeds, and what dashboards say."""
    return [
        sorted(map(str, read(spark, root).collect()))
        for read in (
            tables.read_interactions,
            tables.read_history,
            tables.read_rejects,
            lambda *at: rollups.facets(tables.read_rollups(*at)),
        )
    ]


def plain_files(root, table):
    return {name for name in map(str, __import__("pathlib").Path(f"{root}/{table}").rglob("*.parquet"))}


def test_compaction_changes_nothing_that_is_read(spark):
    root = work_folder(spark, "compacted")
    assert tables.compact(spark, root) is None
    for batch in range(3):
        write(spark, root, batch)
    before = contents(spark, root)
    assert len(before[0]) == 36 and len(before[2]) == 3
    assert tables.compact(spark, root) == 1
    assert batches.loose(spark, root, batches.current(spark, root)) == []
    assert contents(spark, root) == before
    assert tables.compact(spark, root) is None
    write(spark, root, 3)
    write(spark, root, 0, source="S2")
    more = contents(spark, root)
    assert len(more[0]) == 60
    assert tables.compact(spark, root) == 2
    assert contents(spark, root) == more


def test_only_touched_buckets_are_merged_again(spark):
    root = work_folder(spark, "touched")
    write(spark, root, 0)
    tables.compact(spark, root)
    first = batches.current(spark, root).buckets[tables.INTERACTIONS]
    assert len(first) == 6  # two channels, three months
    late = [f"CL-1,CH-1,1,9,{DAYS[-1]},buy"]
    parsed = parsing.parse_messages(spark.createDataFrame([(late[0],)], "value string"))
    ingest.write_batch(parsed, "S1", 1, root)
    tables.compact(spark, root)
    second = batches.current(spark, root).buckets[tables.INTERACTIONS]
    assert second.keys() == first.keys()
    assert [bucket for bucket in first if first[bucket] != second[bucket]] == ["CH-1/2024-03"]


def test_a_batch_replayed_after_compaction_counts_once(spark):
    root = work_folder(spark, "replayed")
    write(spark, root, 0)
    write(spark, root, 1)
    before = contents(spark, root)
    tables.compact(spark, root)
    write(spark, root, 1)
    assert contents(spark, root) == before
    tables.compact(spark, root)
    assert contents(spark, root) == before


def test_a_batch_without_its_commit_is_not_seen(spark, monkeypatch):
    """Neither a batch that broke off between two tables, nor the rest of it in a compaction."""
    root = work_folder(spark, "broken")
    write(spark, root, 0)
    before = contents(spark, root)
    monkeypatch.setattr(files, "claim", lambda *_: pytest.fail("stopped"))
    with pytest.raises(pytest.fail.Exception):
        write(spark, root, 1)
    monkeypatch.undo()
    assert contents(spark, root) == before
    tables.compact(spark, root)
    assert contents(spark, root) == before
    write(spark, root, 1)
    assert tables.read_interactions(spark, root).count() == 24


def upload(spark, root, name, texts):
    path = work_folder(spark, "upload")
    spark.createDataFrame([(text,) for text in texts], "value string").write.text(path)
    requests.load_upload(spark, root, path, "CL-1", "CH-1", name, upload_ms=1)


def test_an_upload_loaded_again_replaces_merged_rows(spark):
    root = work_folder(spark, "uploads")
    stream = [f"CL-1,CH-1,7,1,{DAYS[0]},view"]
    parsed = parsing.parse_messages(spark.createDataFrame([(stream[0],)], "value string"))
    ingest.write_batch(parsed, "S1", 0, root)
    upload(spark, root, "U/1", [f"7,1,{DAYS[0]},buy", f"8,2,{DAYS[2]},view", "bad"])
    upload(spark, root, "U2", [f"9,3,{DAYS[0]},view"])

    def state():
        past = tables.read_history(spark, root).orderBy("user_id")
        counts = requests.upload_chart(spark, root, "U/1").collect()
        return (
            tables.read_interactions(spark, root).count(),
            [(r["user_id"], r["action"]) for r in past.collect()],
            [(r["day"], r["hits"]) for r in counts],
            tables.read_rejects(spark, root).count(),
        )

    first = (4, [(7, "buy"), (8, "view"), (9, "view")], [("2024-01-01", 1), ("2024-02-01", 1)], 1)
    assert state() == first
    tables.compact(spark, root)
    assert state() == first
    # The stream's own row shows again once the upload no longer covers it.
    upload(spark, root, "U/1", [f"8,2,{DAYS[4]},zoom"])
    second = (3, [(7, "view"), (8, "zoom"), (9, "view")], [("2024-03-01", 1)], 0)
    assert state() == second
    tables.compact(spark, root)
    assert state() == second
    assert tables.compact(spark, root) is None


def test_of_two_compactions_one_wins(spark, monkeypatch):
    root = work_folder(spark, "race")
    write(spark, root, 0)
    before, claim = contents(spark, root), files.claim

    def late(session, path, text=""):
        """Somebody else is done while this one is about to claim its generation."""
        if "/generations/" in path:
            monkeypatch.setattr(files, "claim", claim)
            assert tables.compact(spark, root) == 1
        return claim(session, path, text)

    monkeypatch.setattr(files, "claim", late)
    assert tables.compact(spark, root) is None
    assert contents(spark, root) == before
    assert batches.current(spark, root).number == 1


def test_a_generation_claimed_but_not_written_is_passed_over(spark):
    root = work_folder(spark, "claimed")
    write(spark, root, 0)
    before = contents(spark, root)
    tables.compact(spark, root)
    files.claim(spark, f"{root}/generations/{2:012}", '{"buckets": ')
    assert contents(spark, root) == before
    write(spark, root, 1)
    assert tables.compact(spark, root) == 3
    assert tables.read_interactions(spark, root).count() == 24


def test_cleaning_keeps_what_is_read(spark):
    root = work_folder(spark, "cleaned")
    for batch in range(3):
        write(spark, root, batch)
        tables.compact(spark, root)
    upload(spark, root, "U1", [f"7,1,{DAYS[0]},buy"])
    tables.put_catalog(spark.createDataFrame([("C", "name")], "client_id string, name string"), root, tables.CLIENTS)
    before = contents(spark, root)
    files_before = plain_files(root, "merged") | plain_files(root, "batches")
    assert tables.clean(spark, root) == 0  # nothing is a day old
    assert contents(spark, root) == before
    assert tables.clean(spark, root, older_than_ms=-1000) > 0
    assert contents(spark, root) == before
    assert len(plain_files(root, "merged") | plain_files(root, "batches")) < len(files_before) / 2
    assert len(files.listed(spark, f"{root}/commits")) == 2  # the upload and the client are loose
    write(spark, root, 2)  # replayed, long after
    assert contents(spark, root) == before
    tables.compact(spark, root)
    tables.clean(spark, root, older_than_ms=-1000)
    assert contents(spark, root) == before
    assert tables.read_catalog(spark, root, tables.CLIENTS).count() == 1


def test_a_stream_runs_through_compactions(spark):
    """Files come in while the tables are merged again and again; nothing is lost or doubled."""
    root = work_folder(spark, "running")
    for number in range(8):
        messages(spark, number).coalesce(1).write.mode("append").text(f"{root}/messages")
    source = readers.message_files(spark, f"{root}/messages", files_per_batch=1)
    query = ingest.ingest(source, root, f"{root}/checkpoint", available_now=True)
    seen, done = [], threading.Event()

    def read():
        while not done.is_set():
            seen.append(tables.read_interactions(spark, root).count())

    reader = threading.Thread(target=read)
    reader.start()
    compactions = 0
    while query.isActive:
        compactions += tables.compact(spark, root) is not None
        tables.clean(spark, root, older_than_ms=60_000)
    query.awaitTermination()
    done.set()
    reader.join()
    assert compactions >= 2
    assert seen == sorted(seen) and all(count % 12 == 0 for count in seen)
    tables.compact(spark, root)
    assert tables.read_interactions(spark, root).count() == 8 * 12
    assert tables.read_rejects(spark, root).count() == 8
    assert rollups.totals(tables.read_rollups(spark, root)).agg(F.sum("hits")).first()[0] == 8 * 12


def test_reads_prune_folders(spark):
    root = work_folder(spark, "pruned")
    write(spark, root, 0)
    tables.compact(spark, root)
    write(spark, root, 1)
    mine = tables.read_interactions(spark, root).where("channel_id = 'CH-1' AND user_id = 1")
    plan = mine._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 2
    assert all("PartitionFilters: [" in line and "channel_id" in line.split("PartitionFilters")[1] for line in scans)
    assert all("EqualTo(user_id,1)" in line for line in scans)


def test_rollups_say_what_interactions_say(spark):
    root = work_folder(spark, "rollups")
    for batch in range(3):
        write(spark, root, batch)
    upload(spark, root, "U1", [f"{n},{n % 5},{DAYS[n % 6]},buy" for n in range(40)])
    tables.compact(spark, root)
    write(spark, root, 3)
    rows, counts = tables.read_interactions(spark, root), tables.read_rollups(spark, root)
    pairs = [
        (dashboard.daily_counts(rows), rollups.daily_counts(counts)),
        (dashboard.daily_counts(rows, ingestion="stream"), rollups.daily_counts(counts, ingestion="stream")),
        (dashboard.counts_by(rows, "action"), rollups.counts_by(counts, "action")),
        (dashboard.facets(rows), rollups.facets(counts)),
        (dashboard.upload_daily_counts(rows), rollups.upload_daily_counts(counts)),
        # So few users and items are counted exactly.
        (dashboard.totals(rows), rollups.totals(counts)),
        (dashboard.totals(rows, by=["action"]), rollups.totals(counts, by=["action"])),
    ]
    for exact, ours in pairs:
        assert ours.columns == exact.columns
        assert ours.exceptAll(exact).isEmpty() and exact.exceptAll(ours).isEmpty()
    some = rows.where("channel_id = 'CH-1' AND time >= '2024-02-01' AND time < '2024-03-02'")
    (ours,) = requests.audience(spark, root, "CH-1", "2024-02-01", "2024-03-01").collect()
    (exact,) = dashboard.totals(some).collect()
    assert ours == exact


def test_catalog_rows_change_and_go(spark):
    root = work_folder(spark, "catalog")

    def put(*rows):
        tables.put_catalog(spark.createDataFrame(rows, "client_id string, name string"), root, tables.CLIENTS)

    def names():
        return {r["client_id"]: r["name"] for r in tables.read_catalog(spark, root, tables.CLIENTS).collect()}

    put(("C/1", "one"), ("C%2", "two"))
    put(("C/1", "first"))
    assert names() == {"C/1": "first", "C%2": "two"}
    tables.remove_catalog(spark.createDataFrame([("C%2",)], "client_id string"), root, tables.CLIENTS)
    assert names() == {"C/1": "first"}
    tables.compact(spark, root)
    assert names() == {"C/1": "first"}
    put(("C%2", "again"), ("C/1", "last"))
    assert names() == {"C/1": "last", "C%2": "again"}
    tables.compact(spark, root)
    assert names() == {"C/1": "last", "C%2": "again"}
