"""Runs of algorithms: history with durations, and the state of each algorithm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred import schemas
from kindred.functions import keys, times


def history_cells(runs: DataFrame) -> DataFrame:
    """Runs as JSON cells, one per run, qualified by its end time."""
    body = F.to_json(
        F.struct(
            F.col("start_ms").cast("string").alias("startTime"),
            F.col("end_ms").cast("string").alias("endTime"),
            F.col("run_id").cast("string").alias("job"),
            "outcome",
            "output",
        )
    )
    return runs.select(
        keys.joined("channel_id", "algo_id").alias("rowkey"),
        F.lit("jobhistory").alias("family"),
        F.col("end_ms").cast("string").alias("qualifier"),
        body.alias("value"),
    )


def runs_from_cells(cells: DataFrame) -> DataFrame:
    """Runs back from their JSON cells."""
    run = F.from_json("value", schemas.JOB_HISTORY_JSON)
    parsed = cells.where(F.col("family") == "jobhistory").select("rowkey", run.alias("run"))
    return parsed.select(
        keys.part("rowkey", 0).alias("channel_id"),
        keys.part("rowkey", 1).alias("algo_id"),
        F.col("run.job").alias("run_id"),
        F.col("run.startTime").cast("bigint").alias("start_ms"),
        F.col("run.endTime").cast("bigint").alias("end_ms"),
        F.col("run.outcome").alias("outcome"),
        F.col("run.output").alias("output"),
    )


def history(runs: DataFrame) -> DataFrame:
    """Finished runs with their durations; ``rank`` numbers an algorithm's runs, newest first."""
    took = F.col("end_ms") - F.col("start_ms")
    newest = Window.partitionBy("channel_id", "algo_id").orderBy(F.col("end_ms").desc(), "job")
    return runs.select(
        "channel_id",
        "algo_id",
        F.col("run_id").cast("string").alias("job"),
        F.coalesce("outcome", F.lit("NA")).alias("outcome"),
        "output",
        "start_ms",
        "end_ms",
        (took / 1000).cast("bigint").alias("seconds"),
        times.humanised(took).alias("took"),
    ).withColumn("rank", F.row_number().over(newest).cast("bigint"))


def history_of(runs: DataFrame, channel: str, algo: str) -> DataFrame:
    """One algorithm's finished runs, newest first."""
    mine = runs.where((F.col("channel_id") == channel) & (F.col("algo_id") == algo))
    return history(mine).orderBy("rank")


def algorithm_state(runs: DataFrame, now_ms: Column | None = None) -> DataFrame:
    """Last outcome, last success and current version of each algorithm.

    The version is the highest of successful runs; where runs carry none it is their number, as
    only they move it on. With ``now_ms`` the time since the last success is told too.
    """
    succeeded = F.col("outcome") == "success"
    carried = F.col("version") if "version" in runs.columns else F.lit(None)
    last = F.max_by("outcome", F.struct("end_ms", "run_id"))
    success = F.max(F.when(succeeded, F.struct("end_ms", "run_id", "start_ms")))
    state = runs.groupBy("channel_id", "algo_id").agg(
        last.alias("last_outcome"),
        success.alias("success"),
        F.count_if(succeeded).alias("successes"),
        F.max(F.when(succeeded, carried.cast("bigint"))).alias("highest"),
    )
    number = F.coalesce("highest", F.nullif(F.col("successes"), F.lit(0)))
    version = F.when(number.isNotNull(), keys.padded(number))
    columns = [
        "channel_id",
        "algo_id",
        "last_outcome",
        F.col("success.start_ms").alias("last_start_ms"),
        F.col("success.end_ms").alias("last_run_ms"),
        version.alias("version"),
        times.humanised(F.col("success.end_ms") - F.col("success.start_ms")).alias("took"),
    ]
    if now_ms is not None:
        columns.append(times.humanised(now_ms - F.col("success.end_ms")).alias("ago"))
    return state.select(*columns)
