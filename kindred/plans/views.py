"""The test tables seen as canonical tables.

Each view exists twice, as a DataFrame and as the equal SQL text the checks run, and covers
its whole source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the channel of views whose source has no notion of one.
ONE_CHANNEL = "CH-0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as interactions of three channels; purchases are ratings from 1 to 5."""
    events = table(spark, sf_dir, "events")
    streamed = F.col("event_id") % 4 == 0
    rated = F.col("event_type") == "purchase"
    return events.select(
        F.lit("CL-1").alias("client_id"),
        F.concat(F.lit("CH-"), F.col("user_id") % 3).alias("channel_id"),
        F.when(streamed, "stream").otherwise("bulk").alias("ingestion"),
        F.when(~streamed, F.concat(F.lit("F"), F.col("event_id") % 7)).alias("bulkfile"),
        "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("time"),
        F.when(rated, "rating").otherwise(F.col("event_type")).alias("action"),
        F.when(rated, (F.floor("value") % 5 + 1).cast("double")).alias("rating"),
        "event_id",
    )


def interactions_sql(channel: str = "'CH-' || CAST(user_id % 3 AS VARCHAR)") -> str:
    return f"""interactions AS (
  SELECT 'CL-1' AS client_id, {channel} AS channel_id,
         CASE WHEN event_id % 4 = 0 THEN 'stream' ELSE 'bulk' END AS ingestion,
         CASE WHEN event_id % 4 = 0 THEN NULL
              ELSE 'F' || CAST(event_id % 7 AS VARCHAR) END AS bulkfile,
         user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
         date_trunc('second', ts) AS time,
         CASE WHEN event_type = 'purchase' THEN 'rating' ELSE event_type END AS action,
         CASE WHEN event_type = 'purchase'
              THEN CAST(CAST(floor(value) AS BIGINT) % 5 + 1 AS DOUBLE) END AS rating,
         event_id
  FROM events)"""


INTERACTIONS_SQL = interactions_sql()
ONE_CHANNEL_SQL = interactions_sql(f"'{ONE_CHANNEL}'")


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as interactions of a single channel: orders are users, parts are items."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.col("l_orderkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_shipdate").cast("timestamp").alias("time"),
        F.col("l_returnflag").alias("action"),
        F.col("l_quantity").alias("rating"),
    )


BASKETS_SQL = """interactions AS (
  SELECT 'CH-0' AS channel_id, l_orderkey AS user_id, l_partkey AS item_id,
         l_shipdate AS time, l_returnflag AS action, l_quantity AS rating
  FROM lineitem)"""  # the SQL of pairs always groups by channel


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    return nations.select(
        F.format_string("CL-%d", F.col("n_nationkey").cast("bigint")).alias("client_id"),
        F.col("n_name").alias("name"),
        (F.col("n_regionkey") * F.lit(86_400_000_000)).cast("bigint").alias("created_ms"),
    )


CLIENTS_SQL = """clients AS (
  SELECT 'CL-' || CAST(n_nationkey AS VARCHAR) AS client_id, n_name AS name,
         CAST(n_regionkey AS BIGINT) * 86400000000 AS created_ms
  FROM nation)"""


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as channels of even-numbered clients; odd-numbered clients have none."""
    suppliers = table(spark, sf_dir, "supplier")
    nation = F.col("s_nationkey").cast("bigint")
    return suppliers.select(
        F.format_string("CH-%d", "s_suppkey").alias("channel_id"),
        F.format_string("CL-%d", nation - nation % 2).alias("client_id"),
        F.col("s_name").alias("name"),
        (F.col("s_suppkey") * 1000).alias("created_ms"),
    )


CHANNELS_SQL = """channels AS (
  SELECT 'CH-' || CAST(s_suppkey AS VARCHAR) AS channel_id,
         'CL-' || CAST(s_nationkey - s_nationkey % 2 AS VARCHAR) AS client_id,
         s_name AS name, s_suppkey * 1000 AS created_ms
  FROM supplier)"""


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as registered uploads; only the first seven files hold events."""
    suppliers = table(spark, sf_dir, "supplier")
    return suppliers.select(
        F.format_string("CH-%d", F.col("s_suppkey") % 3).alias("channel_id"),
        (F.col("s_suppkey") * 1000).alias("upload_ms"),
        F.format_string("F%d", "s_suppkey").alias("upload_id"),
        F.col("s_name").alias("oname"),
    )


UPLOADS_SQL = """uploads AS (
  SELECT 'CH-' || CAST(s_suppkey % 3 AS VARCHAR) AS channel_id, s_suppkey * 1000 AS upload_ms,
         'F' || CAST(s_suppkey AS VARCHAR) AS upload_id, s_name AS oname
  FROM supplier)"""


def job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as finished runs of twenty algorithms."""
    orders = table(spark, sf_dir, "orders")
    start = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return orders.select(
        F.lit(ONE_CHANNEL).alias("channel_id"),
        F.format_string("AL-%d", F.col("o_custkey") % 20).alias("algo_id"),
        F.col("o_orderkey").alias("run_id"),
        start.alias("start_ms"),
        (start + F.floor("o_totalprice") * 10).alias("end_ms"),
        F.when(F.col("o_orderstatus") == "F", "failure").otherwise("success").alias("outcome"),
        F.col("o_orderpriority").alias("output"),
    )


JOB_RUNS_SQL = """job_runs AS (
  SELECT 'CH-0' AS channel_id, 'AL-' || CAST(o_custkey % 20 AS VARCHAR) AS algo_id,
         o_orderkey AS run_id, epoch_ms(o_orderdate) AS start_ms,
         epoch_ms(o_orderdate) + CAST(floor(o_totalprice) AS BIGINT) * 10 AS end_ms,
         CASE WHEN o_orderstatus = 'F' THEN 'failure' ELSE 'success' END AS outcome,
         o_orderpriority AS output
  FROM orders)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as items of three channels with typed attributes, some values missing."""
    parts = table(spark, sf_dir, "part")
    size = F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("double"))
    return parts.select(
        F.format_string("CH-%d", F.col("p_partkey") % 3).alias("channel_id"),
        F.col("p_partkey").alias("item_id"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("type"),
        size.alias("size"),
        F.col("p_retailprice").alias("price"),
    )


ITEMS_SQL = """items AS (
  SELECT 'CH-' || CAST(p_partkey % 3 AS VARCHAR) AS channel_id, p_partkey AS item_id,
         p_brand AS brand, p_type AS type,
         CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS size,
         p_retailprice AS price
  FROM part)"""

# The attributes declared for the items view.
ITEM_ATTRIBUTES = {
    "brand": ("Brand", "categorical"),
    "type": ("Type", "categorical"),
    "size": ("Size", "numeric"),
    "price": ("Price", "numeric"),
}


def customer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as key-value cells."""
    customers = table(spark, sf_dir, "customer")
    values = {
        "name": F.col("c_name"),
        "nation": F.col("c_nationkey").cast("string"),
        "segment": F.col("c_mktsegment"),
    }
    cells = F.array(
        *[F.struct(F.lit(k).alias("qualifier"), v.alias("value")) for k, v in values.items()]
    )
    return customers.select(
        F.format_string("CL-%d", "c_custkey").alias("rowkey"),
        F.lit("info").alias("family"),
        F.inline(cells),
    )


CUSTOMER_CELLS_SQL = """cells AS (
  SELECT 'CL-' || CAST(c_custkey AS VARCHAR) AS rowkey, 'info' AS family,
         'name' AS qualifier, c_name AS value FROM customer
  UNION ALL
  SELECT 'CL-' || CAST(c_custkey AS VARCHAR), 'info', 'nation', CAST(c_nationkey AS VARCHAR)
  FROM customer
  UNION ALL
  SELECT 'CL-' || CAST(c_custkey AS VARCHAR), 'info', 'segment', c_mktsegment FROM customer)"""
