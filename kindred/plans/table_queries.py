"""Registered queries: ingestion, history, dashboards, catalog, jobs, items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred import schemas
from kindred.functions import keys, text, times
from kindred.operators import (
    catalog,
    content,
    dashboard,
    history,
    items,
    jobs,
    nearest_content,
    rollups,
)
from kindred.plans import algorithms, requests, views
from kindred.plans.registry import Registry
from kindred.session import work_folder
from kindred.sources import cells, parsing, readers, tables
from kindred.streaming import ingest, live

QUERIES = Registry()

ISO_SQL = "strftime(time, '%Y-%m-%dT%H:%M:%S')"
SECONDS_SQL = "strftime(time, '%Y-%m-%d %H:%M:%S')"
DAY_SQL = "strftime(time, '%Y-%m-%d')"

# --- ingestion -----------------------------------------------------------------------------

# Ratings that are no finite plain numbers, by event_id // 6 % 5.
NO_RATINGS = ("many", "NaN", "Infinity", "1e300", "4d")
NO_RATING_SQL = f"({list(NO_RATINGS)!r})[event_id // 6 % {len(NO_RATINGS)} + 1]"

# Every event gives one good line and one line of these kinds, by event_id % 6.
BAD_USER, SHORT, BAD_TIME, EMPTY, LONG, BAD_RATING = range(6)
BULK_LINES_SQL = f"""lines AS (
  SELECT *, CAST(user_id AS VARCHAR) || ',' || CAST(item_id AS VARCHAR) || ',' AS pair,
         event_id % 6 AS kind
  FROM interactions),
odd AS (
  SELECT *, CASE kind WHEN {BAD_USER} THEN 'u' || pair || {SECONDS_SQL} || ',view'
                 WHEN {SHORT} THEN pair || {SECONDS_SQL}
                 WHEN {BAD_TIME} THEN pair || '2024-13-45 00:00:00,view'
                 WHEN {EMPTY} THEN ''
                 WHEN {LONG} THEN pair || {SECONDS_SQL} || ',view,3,more'
                 ELSE pair || {SECONDS_SQL} || ',rating,' || {NO_RATING_SQL} END AS raw
  FROM lines)"""


def _pair() -> list[Column]:
    return [F.col("user_id"), F.col("item_id")]


def _odd_line(prefix: Column) -> Column:
    """A line of the kind the event's number asks for, after some leading fields."""
    time, kind = times.seconds_text("time"), F.col("event_id") % 6
    pair = F.concat_ws(",", *_pair())
    ratings = F.array(*[F.lit(rating) for rating in NO_RATINGS])
    no_rating = F.get(ratings, (F.floor(F.col("event_id") / 6) % len(NO_RATINGS)).cast("int"))
    return (
        F.when(kind == BAD_USER, F.concat(prefix, F.lit("u"), pair, F.lit(","), time,
                                          F.lit(",view")))
        .when(kind == SHORT, F.concat(prefix, pair, F.lit(","), time))
        .when(kind == BAD_TIME, F.concat(prefix, pair, F.lit(",2024-13-45 00:00:00,view")))
        .when(kind == EMPTY, F.lit(""))
        .when(kind == LONG, F.concat(prefix, pair, F.lit(","), time, F.lit(",view,3,more")))
        .otherwise(F.concat(prefix, pair, F.lit(","), time, F.lit(",rating,"), no_rating))
    )


def _bulk_file(spark: SparkSession, sf_dir: str) -> str:
    """Write the events as lines of a bulk file."""
    rows = views.interactions(spark, sf_dir)
    rating = F.col("rating").cast("bigint")
    good = F.concat_ws(",", *_pair(), times.seconds_text("time"), "action", rating)
    lines = rows.select(F.explode(F.array(good, _odd_line(F.lit("")))).alias("value"))
    path = work_folder(spark, "bulk")
    lines.write.text(path)
    return path


def _parsed_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = readers.bulk_lines(spark, _bulk_file(spark, sf_dir))
    return parsing.parse_bulk(lines, "CL-1", "CH-0", "F1")


def _loaded_root(spark: SparkSession, sf_dir: str) -> str:
    """Load the bulk file into tables, return their root."""
    root = work_folder(spark, "loaded")
    path = _bulk_file(spark, sf_dir)
    requests.load_upload(spark, root, path, "CL-1", "CH-0", "F1", upload_ms=1)
    return root


def _iso(rows: DataFrame) -> DataFrame:
    return rows.withColumn("time", times.iso_text("time"))


ACCEPTED_SQL = f"""{views.INTERACTIONS_SQL}, {BULK_LINES_SQL},
accepted AS (
  SELECT user_id, item_id, time, action, rating FROM interactions
  UNION ALL
  SELECT user_id, item_id, time, 'view', NULL FROM odd WHERE kind = {LONG})"""
PARSED_SQL = f"""WITH {ACCEPTED_SQL}
SELECT 'CL-1' AS client_id, 'CH-0' AS channel_id, 'bulk' AS ingestion, 'F1' AS bulkfile,
       * REPLACE ({ISO_SQL} AS time)
FROM accepted"""


@QUERIES.add(PARSED_SQL)
def interactions_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _iso(parsing.accepted(_parsed_bulk(spark, sf_dir)))


@QUERIES.add(
    f"""WITH {views.INTERACTIONS_SQL}, {BULK_LINES_SQL}
SELECT raw, CASE kind WHEN {BAD_USER} THEN 'user is not a number'
                      WHEN {SHORT} THEN 'too few fields'
                      WHEN {BAD_TIME} THEN 'time is not a time'
                      WHEN {EMPTY} THEN 'too few fields'
                      ELSE 'rating is not a number' END AS reason, 'bulk' AS source
FROM odd WHERE kind <> {LONG}"""
)
def interactions_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.rejected(_parsed_bulk(spark, sf_dir))


@QUERIES.add(PARSED_SQL)
def bulk_ingest_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _iso(tables.read_interactions(spark, _loaded_root(spark, sf_dir)))


@QUERIES.add(
    f"""WITH {ACCEPTED_SQL}
SELECT 'CH-0' AS channel_id, user_id, {SECONDS_SQL} AS time, item_id, action, rating
FROM accepted
QUALIFY row_number() OVER (
  PARTITION BY user_id, time, item_id ORDER BY action DESC, rating DESC NULLS LAST) = 1"""
)
def bulk_ingest_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    past = tables.read_history(spark, _loaded_root(spark, sf_dir))
    return past.withColumn("time", times.seconds_text("time")).drop("ingest_seq")


MESSAGE_SQL = (
    "client_id || ',' || channel_id || ',' || CAST(user_id AS VARCHAR) || ',' || "
    f"CAST(item_id AS VARCHAR) || ',' || {SECONDS_SQL} || ',' || action"
)


@QUERIES.add(f"WITH {views.INTERACTIONS_SQL} SELECT {MESSAGE_SQL} AS value FROM interactions")
def message_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.encode_messages(views.interactions(spark, sf_dir))


def _streamed_root(spark: SparkSession, sf_dir: str) -> str:
    """Write the events as message files, run the stream over them, return its tables."""
    rows = views.interactions(spark, sf_dir)
    prefix = F.concat_ws(",", "client_id", "channel_id", F.lit(""))
    odd = rows.select(_odd_line(prefix).alias("value"))
    root = work_folder(spark, "streamed")
    parsing.encode_messages(rows).unionAll(odd).write.text(f"{root}/messages")
    messages = readers.message_files(spark, f"{root}/messages")
    query = ingest.ingest(messages, root, f"{root}/checkpoint", available_now=True)
    query.awaitTermination()
    return root


STREAMED_SQL = f"""{views.INTERACTIONS_SQL}, {BULK_LINES_SQL},
streamed AS (
  SELECT client_id, channel_id, 'stream' AS ingestion, CAST(NULL AS VARCHAR) AS bulkfile,
         user_id, item_id, time, action, CAST(NULL AS DOUBLE) AS rating
  FROM interactions
  UNION ALL
  SELECT client_id, channel_id, 'stream', NULL, user_id, item_id, time, 'view', NULL
  FROM odd WHERE kind = {LONG})"""


@QUERIES.add(
    f"""WITH {STREAMED_SQL}
SELECT * REPLACE ({ISO_SQL} AS time) FROM streamed"""
)
def stream_ingest_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _iso(tables.read_interactions(spark, _streamed_root(spark, sf_dir)))


@QUERIES.add(
    f"""WITH {STREAMED_SQL}
SELECT channel_id, user_id, {SECONDS_SQL} AS time, item_id, max(action) AS action
FROM streamed GROUP BY ALL"""
)
def stream_ingest_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    past = tables.read_history(spark, _streamed_root(spark, sf_dir))
    return past.select(
        "channel_id", "user_id", times.seconds_text("time").alias("time"), "item_id", "action"
    )


@QUERIES.add(
    f"""WITH {views.INTERACTIONS_SQL}, {BULK_LINES_SQL}
SELECT CASE kind WHEN {EMPTY} THEN '' ELSE 'CL-1,' || channel_id || ',' || raw END AS raw,
       CASE kind WHEN {BAD_USER} THEN 'user is not a number'
                 WHEN {SHORT} THEN 'too few fields'
                 WHEN {BAD_TIME} THEN 'time is not a time'
                 WHEN {EMPTY} THEN 'too few fields'
                 ELSE 'rating is not a number' END AS reason, 'stream' AS source
FROM odd WHERE kind <> {LONG}"""
)
def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_rejects(spark, _streamed_root(spark, sf_dir))


def _both_root(spark: SparkSession, sf_dir: str) -> str:
    """Load the bulk file, then stream the messages into the same tables, twice the odd lines:
    a second stream with a checkpoint of its own."""
    root = _streamed_root(spark, sf_dir)
    path = _bulk_file(spark, sf_dir)
    requests.load_upload(spark, root, path, "CL-1", "CH-0", "F1", upload_ms=1)
    rows = views.interactions(spark, sf_dir)
    prefix = F.concat_ws(",", "client_id", "channel_id", F.lit(""))
    rows.select(_odd_line(prefix).alias("value")).write.text(f"{root}/more")
    more = readers.message_files(spark, f"{root}/more")
    ingest.ingest(more, root, f"{root}/more-checkpoint", available_now=True).awaitTermination()
    return root


BOTH_SQL = f"""{STREAMED_SQL},
again AS (
  SELECT client_id, channel_id, 'stream' AS ingestion, CAST(NULL AS VARCHAR) AS bulkfile,
         user_id, item_id, time, 'view' AS action, CAST(NULL AS DOUBLE) AS rating
  FROM odd WHERE kind = {LONG}),
loaded AS (
  SELECT 'CL-1' AS client_id, 'CH-0' AS channel_id, 'bulk' AS ingestion, 'F1' AS bulkfile,
         user_id, item_id, time, action, rating FROM interactions
  UNION ALL
  SELECT 'CL-1', 'CH-0', 'bulk', 'F1', user_id, item_id, time, 'view', NULL
  FROM odd WHERE kind = {LONG})"""


@QUERIES.add(
    f"""WITH {BOTH_SQL}
SELECT * REPLACE ({ISO_SQL} AS time)
FROM (SELECT * FROM loaded UNION ALL SELECT * FROM streamed UNION ALL SELECT * FROM again)"""
)
def bulk_and_streamed_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _iso(tables.read_interactions(spark, _both_root(spark, sf_dir)))


@QUERIES.add(
    f"""WITH {BOTH_SQL},
written AS (
  SELECT channel_id, user_id, time, item_id, action, rating, 1 AS seq FROM loaded
  UNION ALL SELECT channel_id, user_id, time, item_id, action, rating, 2 FROM streamed
  UNION ALL SELECT channel_id, user_id, time, item_id, action, rating, 3 FROM again)
SELECT channel_id, user_id, {SECONDS_SQL} AS time, item_id, action, rating FROM written
QUALIFY row_number() OVER (
  PARTITION BY channel_id, user_id, time, item_id
  ORDER BY seq DESC, action DESC, rating DESC NULLS LAST) = 1"""
)
def bulk_and_streamed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a loaded and a later streamed row for one key the streamed one counts."""
    past = tables.read_history(spark, _both_root(spark, sf_dir))
    return past.withColumn("time", times.seconds_text("time")).drop("ingest_seq")


@QUERIES.add(
    f"""WITH {STREAMED_SQL}
SELECT channel_id, {DAY_SQL} AS day, count(*) AS hits FROM streamed GROUP BY ALL"""
)
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dashboards see streamed rows at their next read."""
    rows = tables.read_interactions(spark, _streamed_root(spark, sf_dir))
    return dashboard.daily_counts(rows, ingestion="stream")


# --- compaction beside writers, rollups ----------------------------------------------------


def _merged_root(spark: SparkSession, sf_dir: str) -> str:
    """The tables of ``_both_root`` after two compactions: the first stream merged, the bulk file
    merged and loaded again, the second stream not merged."""
    root = _streamed_root(spark, sf_dir)
    tables.compact(spark, root)
    path = _bulk_file(spark, sf_dir)
    requests.load_upload(spark, root, path, "CL-1", "CH-0", "F1", upload_ms=1)
    tables.compact(spark, root)
    requests.load_upload(spark, root, path, "CL-1", "CH-0", "F1", upload_ms=1)
    rows = views.interactions(spark, sf_dir)
    prefix = F.concat_ws(",", "client_id", "channel_id", F.lit(""))
    rows.select(_odd_line(prefix).alias("value")).write.text(f"{root}/more")
    more = readers.message_files(spark, f"{root}/more")
    ingest.ingest(more, root, f"{root}/more-checkpoint", available_now=True).awaitTermination()
    return root


MERGED_SQL = f"""{BOTH_SQL},
merged AS (SELECT * FROM loaded UNION ALL SELECT * FROM streamed UNION ALL SELECT * FROM again)"""


@QUERIES.add(QUERIES["bulk_and_streamed_interactions"].sql)
def merged_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _iso(tables.read_interactions(spark, _merged_root(spark, sf_dir)))


@QUERIES.add(QUERIES["bulk_and_streamed_history"].sql)
def merged_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    past = tables.read_history(spark, _merged_root(spark, sf_dir))
    return past.withColumn("time", times.seconds_text("time")).drop("ingest_seq")


@QUERIES.add(
    f"""WITH {MERGED_SQL},
days AS (SELECT channel_id, ingestion, action, {DAY_SQL} AS day FROM merged)
SELECT channel_id,
       CASE WHEN grouping(day) = 0 THEN 'day' WHEN grouping(ingestion) = 0 THEN 'ingestion'
            WHEN grouping(action) = 0 THEN 'action' ELSE 'total' END AS facet,
       coalesce(day, ingestion, action) AS value, count(*) AS hits,
       count(*) FILTER (WHERE days.ingestion = 'stream') AS stream_hits
FROM days
GROUP BY GROUPING SETS (
  (channel_id, day), (channel_id, ingestion), (channel_id, action), (channel_id))"""
)
def rollup_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channel page from rollups alone."""
    return rollups.facets(tables.read_rollups(spark, _merged_root(spark, sf_dir)))


@QUERIES.add(
    f"""WITH {MERGED_SQL}, {views.UPLOADS_SQL},
counts AS (
  SELECT bulkfile, count(*) AS hits, min(time) AS first, max(time) AS last
  FROM merged WHERE bulkfile IS NOT NULL GROUP BY bulkfile)
SELECT u.channel_id, u.upload_id, u.upload_ms, u.oname, coalesce(c.hits, 0) AS hits,
       strftime(c.first, '%Y-%m-%d') AS first_day, strftime(c.last, '%Y-%m-%d') AS last_day,
       CASE WHEN c.hits IS NULL THEN 'processing' ELSE 'done' END AS state,
       row_number() OVER (PARTITION BY u.channel_id ORDER BY u.upload_ms DESC, u.upload_id) AS rank
FROM uploads u LEFT JOIN counts c ON c.bulkfile = u.upload_id"""
)
def rollup_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tables.read_rollups(spark, _merged_root(spark, sf_dir))
    return rollups.upload_summary(views.uploads(spark, sf_dir), counts)


@QUERIES.add(
    f"""WITH {MERGED_SQL},
spans AS (SELECT channel_id, min(CAST(time AS DATE)) + 3 AS first, min(CAST(time AS DATE)) + 12 AS last
          FROM merged GROUP BY ALL)
SELECT channel_id, count(*) AS hits, TRUE AS users_close, TRUE AS items_close
FROM merged JOIN spans USING (channel_id) WHERE CAST(time AS DATE) BETWEEN first AND last GROUP BY ALL"""
)
def rollup_audience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten days of each channel from united sketches, and whether the distinct counts are within
    three times their error of exact ones from the interactions."""
    root = _merged_root(spark, sf_dir)
    rows, counts = tables.read_interactions(spark, root), tables.read_rollups(spark, root)
    begin = F.date_add(F.min("day"), 3)
    spans = counts.groupBy("channel_id").agg(begin.alias("first_day"))
    inside = F.col("day").between(F.col("first_day"), F.date_add("first_day", 9))
    near = rollups.totals(counts.join(spans, "channel_id").where(inside))
    dated = rows.withColumn("day", F.to_date("time")).join(spans, "channel_id")
    exact = dashboard.totals(dated.where(inside)).select(
        "channel_id", F.col("distinct_users").alias("users"), F.col("distinct_items").alias("items")
    )

    def close(name: str) -> Column:
        off = F.abs(F.col(f"distinct_{name}") - F.col(name))
        return (off <= F.greatest(F.lit(1.0), 3 * rollups.DISTINCT_ERROR * F.col(name))).alias(f"{name}_close")

    return near.join(exact, "channel_id").select("channel_id", "hits", close("users"), close("items"))


# --- repeated messages, live windows -------------------------------------------------------


def _split_messages(spark: SparkSession, sf_dir: str, repeats: int = 1) -> str:
    """The events as four message files in the order of their ids, and these again."""
    rows, folder = views.interactions(spark, sf_dir), work_folder(spark, "messages")
    last = rows.agg(F.max("event_id")).first()[0]
    for _ in range(repeats):
        for part in range(4):
            inside = F.floor(F.col("event_id") * 4 / (last + 1)) == part
            lines = parsing.encode_messages(rows.where(inside)).coalesce(1)
            lines.write.mode("append").text(folder)
    return folder


@QUERIES.add(
    f"""WITH {views.INTERACTIONS_SQL}
SELECT DISTINCT client_id, channel_id, 'stream' AS ingestion, CAST(NULL AS VARCHAR) AS bulkfile,
       user_id, item_id, {ISO_SQL} AS time, action, CAST(NULL AS DOUBLE) AS rating
FROM interactions"""
)
def stream_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message comes twice, in different batches."""
    root, folder = work_folder(spark, "deduplicated"), _split_messages(spark, sf_dir, repeats=2)
    source = readers.message_files(spark, folder, files_per_batch=1)
    query = ingest.ingest(source, root, f"{root}/checkpoint", available_now=True, dedup_within="1 day")
    query.awaitTermination()
    return _iso(tables.read_interactions(spark, root))


@QUERIES.add(
    f"""WITH {views.INTERACTIONS_SQL},
placed AS (
  SELECT channel_id, time, CAST(floor(event_id * 4 / (max(event_id) OVER () + 1)) AS BIGINT) AS batch,
         time_bucket(INTERVAL 1 HOUR, time) AS start FROM interactions),
latest AS (SELECT batch, max(time) AS latest FROM placed GROUP BY batch),
marks AS (
  SELECT batch, max(latest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                - INTERVAL 10 MINUTE AS closed FROM latest),
judged AS (
  SELECT channel_id, start, coalesce(start + INTERVAL 1 HOUR <= closed, FALSE) AS late
  FROM placed JOIN marks USING (batch))
SELECT channel_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start,
       count(*) FILTER (WHERE NOT late) AS hits, count(*) FILTER (WHERE late) AS late,
       start + INTERVAL 1 HOUR <= (SELECT max(latest) FROM latest) - INTERVAL 10 MINUTE AS closed
FROM judged GROUP BY channel_id, start"""
)
def stream_live_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of a stream of four batches, with late rows; some of it merged."""
    root, folder = work_folder(spark, "live"), _split_messages(spark, sf_dir)
    source = readers.message_files(spark, folder, files_per_batch=1)
    query = live.count(source, root, f"{root}/checkpoint", available_now=True)
    query.awaitTermination()
    live.compact(spark, root)
    found = live.counts(spark, root, query.id)
    return found.withColumn("window_start", times.seconds_text("window_start")).drop("window_end")


# --- history -------------------------------------------------------------------------------

LATEST_SQL = """latest AS (
  SELECT channel_id, user_id, time, item_id, action, rating
  FROM interactions
  QUALIFY row_number() OVER (
    PARTITION BY channel_id, user_id, time, item_id ORDER BY event_id DESC) = 1)"""


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.interactions(spark, sf_dir)
    return history.latest(history.from_interactions(rows, F.col("event_id")))


@QUERIES.add(
    f"""WITH {views.INTERACTIONS_SQL}, {LATEST_SQL}
SELECT channel_id, user_id, item_id, rating,
       CASE WHEN rating IS NULL THEN action END AS action, {SECONDS_SQL} AS time
FROM latest"""
)
def user_history_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.responses(_latest(spark, sf_dir))


@QUERIES.add(
    f"""WITH {views.INTERACTIONS_SQL}, {LATEST_SQL}
SELECT channel_id || ':' || CAST(user_id AS VARCHAR) AS rowkey, 'i' AS family,
       CAST(CAST(epoch(time) AS BIGINT) AS VARCHAR) || ':' || CAST(item_id AS VARCHAR)
         AS qualifier,
       action || CASE WHEN rating IS NULL THEN ''
                      ELSE ':' || CAST(CAST(rating AS BIGINT) AS VARCHAR) END AS value
FROM latest"""
)
def user_history_encoded_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.to_cells(_latest(spark, sf_dir))


@QUERIES.add(
    f"""WITH {views.INTERACTIONS_SQL}, {LATEST_SQL}
SELECT channel_id, user_id, {SECONDS_SQL} AS time, item_id, action, rating FROM latest"""
)
def user_history_decoded_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.from_cells(history.to_cells(_latest(spark, sf_dir)))
    return rows.withColumn("time", times.seconds_text("time"))


# --- cells ---------------------------------------------------------------------------------


@QUERIES.add(
    f"""WITH {views.CUSTOMER_CELLS_SQL}
SELECT rowkey, max(value) FILTER (WHERE qualifier = 'name') AS name,
       max(value) FILTER (WHERE qualifier = 'nation') AS nation,
       max(value) FILTER (WHERE qualifier = 'segment') AS segment
FROM cells WHERE rowkey LIKE 'CL-%' GROUP BY rowkey"""
)
def cells_to_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cells.with_prefix(views.customer_cells(spark, sf_dir), "CL-")
    return cells.to_records(found, ["name", "nation", "segment"])


@QUERIES.add(f"WITH {views.CUSTOMER_CELLS_SQL} SELECT * FROM cells")
def records_to_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = cells_to_records(spark, sf_dir)
    return cells.from_records(records, "rowkey", ["name", "nation", "segment"])


# --- dashboards ----------------------------------------------------------------------------


def _daily_sql(where: str = "TRUE", by: str = "channel_id") -> str:
    return f"""SELECT {by}, {DAY_SQL} AS day, count(*) AS hits
FROM interactions WHERE {where} GROUP BY ALL"""


@QUERIES.add(f"WITH {views.INTERACTIONS_SQL} {_daily_sql()}")
def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.daily_counts(views.interactions(spark, sf_dir))


@QUERIES.add(
    f"""WITH {views.BASKETS_SQL}, counts AS ({_daily_sql(by="action")}),
spans AS (
  SELECT action, min(CAST(day AS DATE)) AS lo, max(CAST(day AS DATE)) AS hi
  FROM counts GROUP BY ALL),
days AS (
  SELECT action, strftime(unnest(generate_series(lo, hi, INTERVAL 1 DAY)), '%Y-%m-%d') AS day
  FROM spans)
SELECT d.action, d.day, coalesce(c.hits, 0) AS hits
FROM days d LEFT JOIN counts c ON c.action = d.action AND c.day = d.day"""
)
def daily_counts_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = dashboard.daily_counts(views.baskets(spark, sf_dir), by=["action"])
    return dashboard.fill_days(counts, by=["action"])


@QUERIES.add(f"WITH {views.INTERACTIONS_SQL} " + _daily_sql("ingestion = 'stream'"))
def daily_counts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.daily_counts(views.interactions(spark, sf_dir), ingestion="stream")


@QUERIES.add(
    f"WITH {views.INTERACTIONS_SQL} " + _daily_sql("bulkfile IS NOT NULL", "bulkfile")
)
def daily_counts_by_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.upload_daily_counts(views.interactions(spark, sf_dir))


def _top_sql(field: str) -> str:
    return f"""WITH {views.INTERACTIONS_SQL}
SELECT channel_id, {field}, count(*) AS hits FROM interactions
WHERE {field} IS NOT NULL GROUP BY ALL"""


@QUERIES.add(_top_sql("action"))
def counts_by_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.counts_by(views.interactions(spark, sf_dir), "action")


@QUERIES.add(_top_sql("ingestion"))
def counts_by_ingestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.counts_by(views.interactions(spark, sf_dir), "ingestion")


@QUERIES.add(
    f"""WITH {views.INTERACTIONS_SQL}
SELECT channel_id, count(*) AS hits, count(DISTINCT user_id) AS distinct_users,
       count(DISTINCT item_id) AS distinct_items
FROM interactions GROUP BY channel_id"""
)
def channel_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.totals(views.interactions(spark, sf_dir))


@QUERIES.add(
    f"""WITH {views.INTERACTIONS_SQL}
SELECT channel_id, count(*) AS hits, TRUE AS users_close, TRUE AS items_close
FROM interactions GROUP BY channel_id"""
)
def channel_distinct_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate totals, and whether they are within five times their error of the exact ones."""
    rows = views.interactions(spark, sf_dir)
    near = dashboard.totals(rows, exact=False)
    exact = dashboard.totals(rows).select(
        "channel_id",
        F.col("distinct_users").alias("users"),
        F.col("distinct_items").alias("items"),
    )

    def close(approximate: str, true: str) -> Column:
        off = F.abs(F.col(approximate) - F.col(true))
        return off <= 5 * dashboard.DISTINCT_ERROR * F.col(true)

    return near.join(exact, "channel_id").select(
        "channel_id",
        "hits",
        close("distinct_users", "users").alias("users_close"),
        close("distinct_items", "items").alias("items_close"),
    )


@QUERIES.add(
    f"""WITH {views.INTERACTIONS_SQL},
days AS (SELECT channel_id, ingestion, action, {DAY_SQL} AS day FROM interactions)
SELECT channel_id,
       CASE WHEN grouping(day) = 0 THEN 'day' WHEN grouping(ingestion) = 0 THEN 'ingestion'
            WHEN grouping(action) = 0 THEN 'action' ELSE 'total' END AS facet,
       coalesce(day, ingestion, action) AS value, count(*) AS hits,
       count(*) FILTER (WHERE days.ingestion = 'stream') AS stream_hits
FROM days
GROUP BY GROUPING SETS (
  (channel_id, day), (channel_id, ingestion), (channel_id, action), (channel_id))"""
)
def channel_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.facets(views.interactions(spark, sf_dir))


@QUERIES.add(
    f"""WITH {views.INTERACTIONS_SQL}
SELECT channel_id, user_id, item_id, action, rating, {SECONDS_SQL} AS time, rank
FROM (SELECT *, row_number() OVER (
        PARTITION BY channel_id
        ORDER BY time DESC, user_id, item_id, action, rating NULLS FIRST) AS rank
      FROM interactions)
WHERE rank <= {dashboard.BROWSER_ROWS}"""
)
def data_browser(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = dashboard.browse(views.interactions(spark, sf_dir))
    return newest.select(
        "channel_id", "user_id", "item_id", "action", "rating",
        times.seconds_text("time").alias("time"), "rank",
    )


@QUERIES.add(
    f"""WITH {views.INTERACTIONS_SQL}, {views.UPLOADS_SQL},
counts AS (
  SELECT bulkfile, count(*) AS hits, min(time) AS first, max(time) AS last
  FROM interactions WHERE bulkfile IS NOT NULL GROUP BY bulkfile)
SELECT u.channel_id, u.upload_id, u.upload_ms, u.oname, coalesce(c.hits, 0) AS hits,
       strftime(c.first, '%Y-%m-%d') AS first_day, strftime(c.last, '%Y-%m-%d') AS last_day,
       CASE WHEN c.hits IS NULL THEN 'processing' ELSE 'done' END AS state,
       row_number() OVER (PARTITION BY u.channel_id ORDER BY u.upload_ms DESC, u.upload_id) AS rank
FROM uploads u LEFT JOIN counts c ON c.bulkfile = u.upload_id"""
)
def upload_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.upload_summary(
        views.uploads(spark, sf_dir), views.interactions(spark, sf_dir)
    )


# --- catalog and jobs ----------------------------------------------------------------------


@QUERIES.add(
    f"""WITH {views.CLIENTS_SQL}, {views.CHANNELS_SQL}
SELECT c.client_id, c.name, strftime(make_timestamp(c.created_ms * 1000), '%-d %B, %Y')
         AS created,
       h.channel_id IS NOT NULL AS has_channels, h.channel_id, h.name AS channel_name,
       h.created_ms AS channel_created_ms
FROM clients c LEFT JOIN channels h ON h.client_id = c.client_id"""
)
def client_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.clients_with_channels(
        views.clients(spark, sf_dir), views.channels(spark, sf_dir)
    )


@QUERIES.add(
    f"""WITH {views.CLIENTS_SQL}, {views.CHANNELS_SQL}
SELECT c.client_id, c.name, count(h.channel_id) AS channels
FROM clients c LEFT JOIN channels h ON h.client_id = c.client_id GROUP BY ALL"""
)
def client_channel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.channel_counts(views.clients(spark, sf_dir), views.channels(spark, sf_dir))


@QUERIES.add(
    f"""WITH {views.CLIENTS_SQL}
SELECT * FROM clients WHERE regexp_matches(lower(name), 'ation_1.?$')"""
)
def client_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search_clients(views.clients(spark, sf_dir), "ATION_1.?$")


@QUERIES.add(
    f"""WITH {views.CLIENTS_SQL}, {views.CHANNELS_SQL}
SELECT h.channel_id, h.name, h.client_id, c.name AS client_name
FROM channels h JOIN clients c ON c.client_id = h.client_id"""
)
def channel_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.owners(views.channels(spark, sf_dir), views.clients(spark, sf_dir))


def _took_sql(millis: str) -> str:
    return (
        f"CASE WHEN {millis} < 60000 THEN CAST({millis} // 1000 AS VARCHAR) || ' secs' "
        f"WHEN {millis} > 3600000 THEN CAST({millis} // 3600000 AS VARCHAR) || ' hrs' "
        f"ELSE CAST({millis} // 60000 AS VARCHAR) || ' min' END"
    )


@QUERIES.add(
    f"""WITH {views.JOB_RUNS_SQL}
SELECT channel_id, algo_id, CAST(run_id AS VARCHAR) AS job, outcome, output, start_ms, end_ms,
       (end_ms - start_ms) // 1000 AS seconds, {_took_sql("(end_ms - start_ms)")} AS took,
       row_number() OVER (PARTITION BY channel_id, algo_id
                          ORDER BY end_ms DESC, CAST(run_id AS VARCHAR)) AS rank
FROM job_runs"""
)
def job_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the table of runs, filled from their cells."""
    root = work_folder(spark, "runs")
    cells_of_runs = jobs.history_cells(views.job_runs(spark, sf_dir))
    stored = jobs.runs_from_cells(cells_of_runs).withColumn("version", F.lit(None))
    tables.append_runs(stored, root)
    return jobs.history(tables.read_runs(spark, root))


@QUERIES.add(
    f"""WITH {views.JOB_RUNS_SQL},
wins AS (
  SELECT * FROM job_runs WHERE outcome = 'success'
  QUALIFY row_number() OVER (
    PARTITION BY channel_id, algo_id ORDER BY end_ms DESC, CAST(run_id AS VARCHAR) DESC) = 1),
ends AS (
  SELECT * FROM job_runs
  QUALIFY row_number() OVER (
    PARTITION BY channel_id, algo_id ORDER BY end_ms DESC, CAST(run_id AS VARCHAR) DESC) = 1),
wins_count AS (
  SELECT channel_id, algo_id, count(*) AS n FROM job_runs WHERE outcome = 'success'
  GROUP BY ALL)
SELECT e.channel_id, e.algo_id, e.outcome AS last_outcome, w.start_ms AS last_start_ms,
       w.end_ms AS last_run_ms, lpad(CAST(n.n AS VARCHAR), 6, '0') AS version,
       {_took_sql("(w.end_ms - w.start_ms)")} AS took
FROM ends e
LEFT JOIN wins w ON w.channel_id = e.channel_id AND w.algo_id = e.algo_id
LEFT JOIN wins_count n ON n.channel_id = e.channel_id AND n.algo_id = e.algo_id"""
)
def algo_run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_folder(spark, "runs")
    tables.append_runs(
        views.job_runs(spark, sf_dir).withColumn("version", F.lit(None)), root
    )
    return jobs.algorithm_state(tables.read_runs(spark, root))


@QUERIES.add(
    f"""WITH {views.CLIENTS_SQL}, {views.CHANNELS_SQL},
made AS (
  SELECT client_id AS of, 'CL-' || printf('%X', created_ms) AS timed_id, created_ms FROM clients
  UNION ALL
  SELECT channel_id, 'CH-' || printf('%X', created_ms), created_ms FROM channels)
SELECT * FROM made"""
)
def timed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids made from creation times, and the times read back from the ids."""

    def made(rows: DataFrame, of: str, prefix: str) -> DataFrame:
        timed = keys.timed_id(prefix, F.col("created_ms"))
        return rows.select(F.col(of).alias("of"), timed.alias("timed_id"))

    both = made(views.clients(spark, sf_dir), "client_id", keys.CLIENT_PREFIX).unionByName(
        made(views.channels(spark, sf_dir), "channel_id", keys.CHANNEL_PREFIX)
    )
    return both.withColumn("created_ms", keys.id_millis("timed_id"))


@QUERIES.add(
    """SELECT o_orderkey AS run_id,
       '["' || o_orderpriority || '","' || o_orderstatus || '"]' AS cell,
       o_orderpriority || ',' || o_orderstatus AS actions
FROM orders"""
)
def action_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action lists as typed in a form, as their JSON cell, and joined again from it."""
    orders = views.table(spark, sf_dir, "orders")
    typed = F.concat(F.lit(" "), "o_orderpriority", F.lit(" , "), "o_orderstatus")
    cells_of_runs = orders.select(
        F.col("o_orderkey").alias("run_id"),
        text.actions_to_json(text.action_list(typed)).alias("cell"),
    )
    joined = text.actions_text(text.actions_from_json("cell"))
    return cells_of_runs.withColumn("actions", joined)


# --- items ---------------------------------------------------------------------------------


def _submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two submissions per part; some second ones carry an undeclared attribute."""
    parts = views.table(spark, sf_dir, "part")

    def submission(seq: int, more: Column) -> Column:
        price = F.col("p_retailprice") + seq
        attributes = F.map_concat(
            F.create_map(
                F.lit("brand"), F.col("p_brand"),
                F.lit("type"), F.col("p_type"),
                F.lit("size"), F.concat(F.col("p_size").cast("string"), F.lit(" cm")),
                F.lit("price"), F.floor(price).cast("string"),
            ),
            more,
        )
        return F.struct(F.lit(seq).cast("bigint").alias("seq"), attributes.alias("attributes"))

    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    colour = F.create_map(F.lit("colour"), F.col("p_name"))
    undeclared = F.when(F.col("p_partkey") % 11 == 0, colour).otherwise(none)
    both = F.array(submission(1, none), submission(2, undeclared))
    return parts.select(
        F.lit(views.ONE_CHANNEL).alias("channel_id"),
        F.col("p_partkey").alias("item_id"),
        F.inline(both),
    )


@QUERIES.add(
    """SELECT 'CH-0' AS channel_id, p_partkey AS item_id, p_brand AS brand, p_type AS type,
       CAST(p_size AS DOUBLE) AS size,
       floor(p_retailprice + CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 2 END) AS price
FROM part"""
)
def item_metadata_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the table of submissions, whose schema changes after they were checked."""
    root, channel = work_folder(spark, "items"), views.ONE_CHANNEL
    declared = items.declaration(spark, channel, views.ITEM_ATTRIBUTES)
    tables.append_items(_submissions(spark, sf_dir), root, declared)
    return tables.read_items(spark, root, channel, views.ITEM_ATTRIBUTES).drop("document_id")


@QUERIES.add(
    """SELECT 'CH-0' AS channel_id, p_partkey AS item_id, CAST(2 AS BIGINT) AS seq,
       'colour' AS undeclared
FROM part WHERE p_partkey % 11 = 0"""
)
def item_metadata_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_folder(spark, "items")
    declared = items.declaration(spark, views.ONE_CHANNEL, views.ITEM_ATTRIBUTES)
    tables.append_items(_submissions(spark, sf_dir), root, declared)
    return tables.read_item_rejects(spark, root)


_COVERED = {
    "brand": "brand IS NOT NULL",
    "type": "type IS NOT NULL",
    "size": "size > 0",
    "price": "price > 0",
}


@QUERIES.add(
    f"WITH {views.ITEMS_SQL} "
    + " UNION ALL ".join(
        f"""SELECT channel_id, count(*) AS total, '{key}' AS attribute, '{label}' AS label,
       '{kind}' AS type, count(*) FILTER (WHERE {_COVERED[key]}) AS covered,
       CAST(floor(count(*) FILTER (WHERE {_COVERED[key]}) / CAST(count(*) AS DOUBLE) * 100)
            AS BIGINT) AS percent
FROM items GROUP BY channel_id"""
        for key, (label, kind) in views.ITEM_ATTRIBUTES.items()
    )
)
def attribute_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.coverage(views.items(spark, sf_dir), views.ITEM_ATTRIBUTES)


_CATEGORICAL = {
    key: label for key, (label, kind) in views.ITEM_ATTRIBUTES.items() if kind == "categorical"
}


@QUERIES.add(
    f"""WITH {views.ITEMS_SQL}
SELECT channel_id, item_id, 'Brand' AS label, 'categorical' AS type, brand AS value FROM items
UNION ALL SELECT channel_id, item_id, 'Type', 'categorical', type FROM items
UNION ALL SELECT channel_id, item_id, 'Size', 'numeric', CAST(size AS VARCHAR) FROM items
          WHERE size IS NOT NULL
UNION ALL SELECT channel_id, item_id, 'Price', 'numeric', CAST(price AS VARCHAR) FROM items"""
)
def item_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.profiles(views.items(spark, sf_dir), views.ITEM_ATTRIBUTES)


@QUERIES.add(
    f"WITH {views.INTERACTIONS_SQL} " + _daily_sql(by="channel_id, item_id")
)
def item_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.profile_counts(views.interactions(spark, sf_dir))


def _median_sql(by: str = "") -> str:
    """One row per group with its exact median size."""
    group, window = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    return f"""SELECT {group}(min(size) FILTER (WHERE r > (n - 1) // 2)
              + min(size) FILTER (WHERE r > n // 2)) / 2 AS filler
  FROM (SELECT {group}size, row_number() OVER ({window} ORDER BY size) AS r,
               count(*) OVER ({window}) AS n
        FROM items WHERE size IS NOT NULL) {"GROUP BY " + by if by else ""}"""


def _imputed(policy: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = views.items(spark, sf_dir)
        filled = content.impute(rows, views.ITEM_ATTRIBUTES, policy)
        return filled.select("channel_id", "item_id", "brand", "type", "size", "price")

    return build


for _policy, _fillers in {
    content.ZERO: "SELECT DISTINCT channel_id, 0.0 AS filler FROM items",
    content.MEAN: "SELECT channel_id, avg(size) AS filler FROM items GROUP BY channel_id",
    content.MEDIAN: _median_sql("channel_id"),
}.items():
    QUERIES.add(
        f"""WITH {views.ITEMS_SQL}, fillers AS ({_fillers})
SELECT i.channel_id, item_id, brand, type, coalesce(size, filler) AS size, price
FROM items i LEFT JOIN fillers f ON f.channel_id = i.channel_id""",
        f"content_impute_{_policy}",
    )(_imputed(_policy))


@QUERIES.add(
    f"""WITH {views.ITEMS_SQL},
filled AS (SELECT * REPLACE (coalesce(size, ({_median_sql()})) AS size) FROM items),
scaled AS (
  SELECT item_id, brand, type,
         (size - (SELECT min(size) FROM filled))
           / ((SELECT max(size) FROM filled) - (SELECT min(size) FROM filled)) AS size,
         (price - (SELECT min(price) FROM filled))
           / ((SELECT max(price) FROM filled) - (SELECT min(price) FROM filled)) AS price
  FROM filled),
normed AS (SELECT *, sqrt(size * size + price * price + 2) AS norm FROM scaled)
SELECT t.item_id, o.item_id AS other_id,
       CAST(round((o.size * t.size + o.price * t.price
                   + CASE WHEN o.brand = t.brand THEN 1 ELSE 0 END
                   + CASE WHEN o.type = t.type THEN 1 ELSE 0 END)
                  / (o.norm * t.norm) * 1000) AS BIGINT) AS score
FROM normed o, normed t
WHERE t.item_id = 7 AND o.item_id <> 7
ORDER BY score DESC, other_id LIMIT 20"""
)
def content_similar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as one channel."""
    return content.similar_by_content(
        views.items(spark, sf_dir), views.ITEM_ATTRIBUTES, content.MEDIAN, item=7, num=20
    )


@QUERIES.add(
    f"""WITH {views.ITEMS_SQL},
filled AS (SELECT * REPLACE (coalesce(size, ({_median_sql()})) AS size) FROM items),
scaled AS (
  SELECT item_id, brand, type,
         (size - (SELECT min(size) FROM filled))
           / ((SELECT max(size) FROM filled) - (SELECT min(size) FROM filled)) AS size,
         (price - (SELECT min(price) FROM filled))
           / ((SELECT max(price) FROM filled) - (SELECT min(price) FROM filled)) AS price
  FROM filled),
normed AS (SELECT *, sqrt(size * size + price * price + 2) AS norm FROM scaled),
scored AS (
  SELECT t.item_id, o.item_id AS other_id,
         CAST(floor((o.size * t.size + o.price * t.price
                     + CASE WHEN o.brand = t.brand THEN 1 ELSE 0 END
                     + CASE WHEN o.type = t.type THEN 1 ELSE 0 END)
                    / (o.norm * t.norm) * 1000 + 0.5) AS BIGINT) AS score
  FROM normed o JOIN normed t ON t.item_id <> o.item_id)
SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, other_id) AS rank
FROM scored QUALIFY rank <= 10"""
)
def content_similar_items_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar parts of every part, all parts as one channel."""
    prepared = content.vectors(views.items(spark, sf_dir), views.ITEM_ATTRIBUTES, content.MEDIAN)
    best, _ = nearest_content.similar_items(prepared, 10, block_items=32)
    return best


# --- stored catalog and content vectors ----------------------------------------------------


def _catalog_root(spark: SparkSession, sf_dir: str) -> str:
    """Clients, channels, uploads, interactions and attributes in tables of their own."""
    root = work_folder(spark, "catalog")
    tables.put_catalog(views.clients(spark, sf_dir), root, tables.CLIENTS)
    tables.put_catalog(views.channels(spark, sf_dir), root, tables.CHANNELS)
    return root


@QUERIES.add(QUERIES["client_channels"].sql)
def stored_client_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.clients(spark, _catalog_root(spark, sf_dir))


@QUERIES.add(
    f"""WITH {views.CLIENTS_SQL}, {views.CHANNELS_SQL},
edited AS (
  SELECT client_id, CASE WHEN created_ms % 3 = 0 THEN name || ' & Co' ELSE name END AS name, created_ms
  FROM (SELECT * REPLACE (created_ms + CAST(substr(client_id, 4) AS BIGINT) AS created_ms) FROM clients)
  WHERE created_ms % 5 <> 0),
moved AS (
  SELECT channel_id, name, created_ms,
         CASE WHEN created_ms % 4000 = 0 THEN 'CL-1' ELSE client_id END AS client_id FROM channels)
SELECT c.client_id, c.name, count(h.channel_id) AS channels
FROM edited c LEFT JOIN moved h ON h.client_id = c.client_id GROUP BY ALL"""
)
def edited_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients renamed or removed and channels given to another client, some of it merged."""
    root = work_folder(spark, "edited")
    number = F.substring("client_id", 4, 9).cast("bigint")
    clients = views.clients(spark, sf_dir).withColumn("created_ms", F.col("created_ms") + number)
    channels = views.channels(spark, sf_dir)
    tables.put_catalog(clients, root, tables.CLIENTS)
    tables.put_catalog(channels, root, tables.CHANNELS)
    renamed = clients.where("created_ms % 3 = 0").withColumn("name", F.concat("name", F.lit(" & Co")))
    tables.put_catalog(renamed, root, tables.CLIENTS)
    tables.compact(spark, root)
    moved = channels.where("created_ms % 4000 = 0").withColumn("client_id", F.lit("CL-1"))
    tables.put_catalog(moved, root, tables.CHANNELS)
    tables.remove_catalog(clients.where("created_ms % 5 = 0"), root, tables.CLIENTS)
    return catalog.channel_counts(
        tables.read_catalog(spark, root, tables.CLIENTS), tables.read_catalog(spark, root, tables.CHANNELS)
    )


@QUERIES.add(
    f"""WITH {views.CHANNELS_SQL}
SELECT channel_id, client_id, name, created_ms,
       strftime(make_timestamp(created_ms * 1000), '%-d %B, %Y') AS created,
       row_number() OVER (ORDER BY created_ms DESC, channel_id) AS rank
FROM channels WHERE client_id = 'CL-2'"""
)
def stored_channels_of_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.channels(spark, _catalog_root(spark, sf_dir), "CL-2")


@QUERIES.add(
    f"""WITH {views.INTERACTIONS_SQL}, {views.UPLOADS_SQL},
counts AS (
  SELECT bulkfile, count(*) AS hits, min(time) AS first, max(time) AS last
  FROM interactions WHERE bulkfile IS NOT NULL AND channel_id = 'CH-1' GROUP BY bulkfile)
SELECT u.channel_id, u.upload_id, u.upload_ms, u.oname, coalesce(c.hits, 0) AS hits,
       strftime(c.first, '%Y-%m-%d') AS first_day, strftime(c.last, '%Y-%m-%d') AS last_day,
       CASE WHEN c.hits IS NULL THEN 'processing' ELSE 'done' END AS state,
       row_number() OVER (ORDER BY u.upload_ms DESC, u.upload_id) AS rank
FROM uploads u LEFT JOIN counts c ON c.bulkfile = u.upload_id WHERE u.channel_id = 'CH-1'"""
)
def stored_uploads_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_folder(spark, "uploads")
    tables.put_catalog(views.uploads(spark, sf_dir), root, tables.UPLOADS)
    tables.append_interactions(views.interactions(spark, sf_dir).drop("event_id"), root)
    return requests.uploads(spark, root, "CH-1")


def _items_root(spark: SparkSession, sf_dir: str) -> str:
    """All parts as submitted items of one channel with its declared attributes."""
    root, channel = work_folder(spark, "stored-items"), views.ONE_CHANNEL
    declared = items.declaration(spark, channel, views.ITEM_ATTRIBUTES)
    tables.put_catalog(declared, root, tables.ATTRIBUTES)
    texts = {key: F.col(key).cast("string") for key in views.ITEM_ATTRIBUTES}
    pairs = F.create_map(*[part for key, value in texts.items() for part in (F.lit(key), value)])
    submitted = views.items(spark, sf_dir).select(
        F.lit(channel).alias("channel_id"),
        "item_id",
        F.lit(1).cast("bigint").alias("seq"),
        F.map_filter(pairs, lambda _, value: value.isNotNull()).alias("attributes"),
    )
    tables.append_items(submitted, root, tables.read_catalog(spark, root, tables.ATTRIBUTES))
    return root


@QUERIES.add(
    f"WITH {views.ITEMS_SQL} "
    + " UNION ALL ".join(
        f"""SELECT 'CH-0' AS channel_id, count(*) AS total, '{key}' AS attribute,
       '{label}' AS label, '{kind}' AS type, count(*) FILTER (WHERE {_COVERED[key]}) AS covered,
       CAST(floor(count(*) FILTER (WHERE {_COVERED[key]}) / CAST(count(*) AS DOUBLE) * 100)
            AS BIGINT) AS percent
FROM items"""
        for key, (label, kind) in views.ITEM_ATTRIBUTES.items()
    )
)
def stored_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.coverage(spark, _items_root(spark, sf_dir), views.ONE_CHANNEL)


@QUERIES.add(
    f"SELECT other_id AS item, score FROM ({QUERIES['content_similar_items'].sql}) AS found"
)
def served_content_similar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the published vectors of a content-based algorithm in the catalog."""
    root, channel, algo = _items_root(spark, sf_dir), views.ONE_CHANNEL, "AL-content"
    row = [(channel, algo, "contentbased", None, content.MEDIAN)]
    defined = spark.createDataFrame(row, schemas.ALGORITHMS)
    tables.put_catalog(defined, root, tables.ALGORITHMS)
    algorithms.run(spark, root, None, algorithms.stored(spark, root, channel, algo))
    return requests.similar_items(spark, root, channel, algo, 7, 20)


# --- requests over stored tables -----------------------------------------------------------

CHANNEL, USER, ITEM, UPLOAD = "CH-1", 4, 10, "F2"


def _events_root(spark: SparkSession, sf_dir: str) -> str:
    """All events in the interaction and history tables."""
    root = work_folder(spark, "events")
    rows = views.interactions(spark, sf_dir)
    tables.append_interactions(rows.drop("event_id"), root)
    tables.append_history(rows, root, F.col("event_id"))
    return root


@QUERIES.add(
    f"""WITH {views.INTERACTIONS_SQL}, {LATEST_SQL}
SELECT channel_id, user_id, item_id, rating,
       CASE WHEN rating IS NULL THEN action END AS action, {SECONDS_SQL} AS time,
       row_number() OVER (ORDER BY time DESC, item_id) AS rank
FROM latest WHERE channel_id = '{CHANNEL}' AND user_id = {USER}"""
)
def requested_user_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user's history, newest first."""
    return requests.user_history(spark, _events_root(spark, sf_dir), CHANNEL, USER)


@QUERIES.add(
    f"WITH {views.INTERACTIONS_SQL} " + _daily_sql(f"bulkfile = '{UPLOAD}'", "bulkfile")
)
def requested_upload_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.upload_chart(spark, _events_root(spark, sf_dir), UPLOAD)


@QUERIES.add(
    f"WITH {views.INTERACTIONS_SQL} "
    + _daily_sql(f"channel_id = '{CHANNEL}' AND item_id = {ITEM}", "channel_id, item_id")
)
def requested_item_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _events_root(spark, sf_dir)
    _, days = requests.item_page(spark, root, CHANNEL, ITEM, views.ITEM_ATTRIBUTES)
    return days


@QUERIES.add(
    """SELECT count(*) AS items, count(DISTINCT p_partkey) AS ids, TRUE AS stable FROM part"""
)
def item_document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item has one surrogate id, the same whenever it is made."""
    parts = views.table(spark, sf_dir, "part").select("p_partkey")
    made = keys.item_document_id(F.lit(CHANNEL), F.col("p_partkey").cast("string"))
    again = F.xxhash64(F.concat(F.lit(f"{CHANNEL}:"), F.col("p_partkey").cast("string")))
    return parts.agg(
        F.count("*").alias("items"),
        F.count_distinct(made).alias("ids"),
        F.bool_and(made == again).alias("stable"),
    )
