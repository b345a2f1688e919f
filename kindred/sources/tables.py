"""The written tables: partitioned Parquet under one root folder.

Tables fed in batches, which ``batches`` lays out, merges and reads:

    interactions, history, rollups        of a channel; history: latest row per key wins on reading
    rejects                               lines that did not parse
    items, item_rejects                   submissions, and refused ones with undeclared attributes
    job_runs                              one row per finished run
    clients, channels, algorithms, uploads, attributes
                                          the catalog: the latest row per key counts

Results, one folder per version:

    similarity, recommendations, vectors/channel_id=…/algo_id=…/version=…
    claims/…                              the versions that runs have taken
"""

from __future__ import annotations

import time
import uuid
from functools import partial
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred import schemas
from kindred.functions import keys
from kindred.operators import history as histories
from kindred.operators import items, rollups
from kindred.sources import batches, files

INTERACTIONS, HISTORY, REJECTS, ROLLUPS = "interactions", "history", "rejects", "rollups"
JOB_RUNS, ITEMS, ITEM_REJECTS = "job_runs", "items", "item_rejects"
SIMILARITY, RECOMMENDATIONS, VECTORS = "similarity", "recommendations", "vectors"
RESULT_SCHEMAS = {
    SIMILARITY: schemas.SIMILARITY,
    RECOMMENDATIONS: schemas.RECOMMENDATIONS,
    VECTORS: schemas.VECTORS,
}
CLIENTS, CHANNELS, ALGORITHMS, UPLOADS, ATTRIBUTES = CATALOG = (
    "clients", "channels", "algorithms", "uploads", "attributes",
)
CATALOG_SCHEMAS = {
    CLIENTS: schemas.CLIENTS,
    CHANNELS: schemas.CHANNELS,
    ALGORITHMS: schemas.ALGORITHMS,
    UPLOADS: schemas.UPLOADS,
    ATTRIBUTES: schemas.ATTRIBUTES,
}
# What tells the rows of a catalog table apart; of several with one key the latest counts.
CATALOG_KEYS = {
    CLIENTS: ("client_id",),
    CHANNELS: ("channel_id",),
    ALGORITHMS: ("channel_id", "algo_id"),
    UPLOADS: ("channel_id", "upload_id"),
    ATTRIBUTES: ("channel_id", "key"),
}
# The column point reads filter on: rows are clustered and sorted by it.
SUBJECT = {SIMILARITY: "item_id", RECOMMENDATIONS: "user_id", VECTORS: "item_id"}
# Parts of a channel's users or items that a compaction rewrites on their own.
PARTS = 16


def _month() -> Column:
    return F.date_format("time", "yyyy-MM")


def _today() -> Column:
    """Rows that are only added to: what is merged today lies apart from earlier days."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd")


def _part(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(PARTS)).cast("string")


def _latest_rows(name: str, rows: DataFrame) -> DataFrame:
    """The latest row per key of a catalog table, removed ones included."""
    key = CATALOG_KEYS[name]
    others = [column for column in rows.columns if column not in (*key, "written")]
    newest = F.max(F.struct("written", *others)).alias("newest")
    return rows.groupBy(*key).agg(newest).select(*key, "newest.*")


TABLES = {
    table.name: table
    for table in (
        batches.Table(INTERACTIONS, schemas.INTERACTIONS, _month, order=("time",)),
        batches.Table(
            HISTORY,
            schemas.USER_HISTORY,
            partial(_part, "user_id"),
            # Rows that a later load may take back don't hide others for good.
            partial(histories.latest, also=(batches.OWNER,)),
            order=("user_id", "time"),
        ),
        batches.Table(
            ROLLUPS,
            schemas.ROLLUPS,
            lambda: F.date_format("day", "yyyy-MM"),
            partial(rollups.merged, keys=(*rollups.KEYS, batches.OWNER)),
            order=("day",),
        ),
        batches.Table(REJECTS, schemas.REJECTS, _today, partitions=()),
        batches.Table(ITEMS, schemas.ITEM_SUBMISSIONS, partial(_part, "item_id"), order=("item_id",)),
        batches.Table(ITEM_REJECTS, schemas.ITEM_REJECTS, _today),
        batches.Table(JOB_RUNS, schemas.JOB_RUNS, partial(_part, "algo_id"), order=("algo_id", "end_ms")),
        *(
            batches.Table(
                name,
                f"{schema}, written bigint, removed boolean",
                partial(_part, *CATALOG_KEYS[name]),
                partial(_latest_rows, name),
                partitions=(),
            )
            for name, schema in CATALOG_SCHEMAS.items()
        ),
    )
}


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, empty before its first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType.fromDDL(schema))


def _append(root: str, **outputs: DataFrame) -> None:
    """Add rows that nothing replaces: a source with a single batch."""
    named = {TABLES[name]: rows for name, rows in outputs.items()}
    batches.write(named, root, uuid.uuid4().hex, 0, batches.ONCE)


def _fitted(rows: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema; those that are missing stay empty."""
    return rows.select(
        *[
            (F.col(field.name) if field.name in rows.columns else F.lit(None))
            .cast(field.dataType)
            .alias(field.name)
            for field in T.StructType.fromDDL(schema).fields
        ]
    )


def ingested(
    rows: DataFrame, past: DataFrame, refused: DataFrame
) -> dict[batches.Table, DataFrame]:
    """What one batch of parsed lines writes: interactions with their rollup, history, rejects."""
    written = {INTERACTIONS: rows, ROLLUPS: rollups.rolled_up(rows), HISTORY: past, REJECTS: refused}
    return {TABLES[name]: frame for name, frame in written.items()}


def append_interactions(interactions: DataFrame, root: str) -> None:
    """Append, as the feed allows repeated rows: replaying an upload duplicates it."""
    rows = _fitted(interactions, schemas.INTERACTIONS)
    _append(root, interactions=rows, rollups=rollups.rolled_up(rows))


def read_interactions(spark: SparkSession, root: str) -> DataFrame:
    """All interactions, bulk and streamed."""
    return batches.read(spark, root, TABLES[INTERACTIONS])


def read_rollups(spark: SparkSession, root: str) -> DataFrame:
    """Counts and sketches of all interactions; rows of several batches may share their keys."""
    return batches.read(spark, root, TABLES[ROLLUPS])


def append_history(interactions: DataFrame, root: str, ingest_seq: Column) -> None:
    _append(root, history=histories.from_interactions(interactions, ingest_seq))


def read_history(spark: SparkSession, root: str) -> DataFrame:
    """The latest history row per (channel, user, second, item)."""
    return histories.latest(batches.read(spark, root, TABLES[HISTORY]))


def append_rejects(rejects: DataFrame, root: str) -> None:
    _append(root, rejects=rejects)


def read_rejects(spark: SparkSession, root: str) -> DataFrame:
    return batches.read(spark, root, TABLES[REJECTS])


def compact(spark: SparkSession, root: str) -> int | None:
    """Merge what was written since the last time into even, sorted files, beside running streams
    and loads; returns the number of the new generation, or None.

    Interactions lie by month and sorted by time, history holds only the latest rows and lies sorted
    by user, so that filters on them skip files and row groups.
    """
    return batches.compact(spark, root, list(TABLES.values()))


def clean(spark: SparkSession, root: str, older_than_ms: int = 86_400_000) -> int:
    """Delete files that compactions made needless, once no reader can be using them any more."""
    return batches.clean(spark, root, list(TABLES.values()), older_than_ms)


def append_items(submissions: DataFrame, root: str, declared: DataFrame) -> None:
    """Keep the submissions whose attributes are all declared, and record the others.

    ``declared`` is the attribute table: ``channel_id, key`` and more.
    """
    _append(root, items=items.valid(submissions, declared), item_rejects=items.rejected(submissions, declared))


def read_item_rejects(spark: SparkSession, root: str) -> DataFrame:
    return batches.read(spark, root, TABLES[ITEM_REJECTS])


def read_items(
    spark: SparkSession, root: str, channel: str, attributes: items.Attributes
) -> DataFrame:
    """The latest typed record per item of a channel, with its declared attributes.

    Submissions were checked when they were written, so a schema that has changed since gives
    other columns and hides no item.
    """
    stored = batches.read(spark, root, TABLES[ITEMS])
    mine = stored.where(F.col("channel_id") == channel)
    return items.latest(items.typed(mine, attributes), attributes)


def put_catalog(rows: DataFrame, root: str, name: str) -> None:
    """Add rows to a table of the catalog, or change those that are there under the same key.

    Columns that are missing become empty. Rows written later win, by the clock of the driver.
    """
    _write_catalog(rows, root, name, removed=False)


def remove_catalog(rows: DataFrame, root: str, name: str) -> None:
    """Take the rows with these keys out of a table of the catalog; they may be put again."""
    _write_catalog(rows.select(*CATALOG_KEYS[name]), root, name, removed=True)


def _write_catalog(rows: DataFrame, root: str, name: str, removed: bool) -> None:
    marked = _fitted(rows, CATALOG_SCHEMAS[name]).withColumns(
        {"written": F.lit(time.time_ns() // 1000), "removed": F.lit(removed)}
    )
    _append(root, **{name: marked})


def read_catalog(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The latest row per key, without removed ones."""
    latest = _latest_rows(name, batches.read(spark, root, TABLES[name]))
    columns = T.StructType.fromDDL(CATALOG_SCHEMAS[name]).names
    return latest.where(~F.col("removed")).select(*columns)


def _best_first(kind: str) -> list[Column]:
    return [] if kind == VECTORS else [F.col("score").desc()]


def write_result(
    rows: DataFrame, root: str, kind: str, channel: str, algo: str, version: str
) -> None:
    """Write one version of a result, replacing what a failed run may have left there.

    Rows lie sorted by the item or user they answer for, so reading one of them skips most
    row groups by their statistics. The rebalance hint gives files of even size, splitting
    what one item or user has too much of.
    """
    subject = SUBJECT[kind]
    places = {"channel_id": channel, "algo_id": algo, "version": version}
    folder = "/".join([root, kind, *(f"{name}={keys.folder_value(value)}" for name, value in places.items())])
    columns = [
        field.name
        for field in T.StructType.fromDDL(RESULT_SCHEMAS[kind]).fields
        if field.name not in ("channel_id", "algo_id", "version")
    ]
    (
        rows.select(*columns)
        .hint("rebalance", subject)
        .sortWithinPartitions(subject, *_best_first(kind))
        .write.mode("overwrite")
        .parquet(folder)
    )


def read_results(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """All published versions; channel, algorithm and version are partition columns."""
    return _read(spark, f"{root}/{kind}", RESULT_SCHEMAS[kind])


def record_run(spark: SparkSession, root: str, **run) -> None:
    """Append one finished run; it gets an id of its own unless one is given."""
    fields = T.StructType.fromDDL(schemas.JOB_RUNS)
    run = {"run_id": uuid.uuid4().hex, **run}
    row = [tuple(run.get(name) for name in fields.names)]
    append_runs(spark.createDataFrame(row, fields).coalesce(1), root)


def append_runs(runs: DataFrame, root: str) -> None:
    _append(root, job_runs=_fitted(runs, schemas.JOB_RUNS))


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    return batches.read(spark, root, TABLES[JOB_RUNS])


def current_versions(runs: DataFrame) -> DataFrame:
    """The version each algorithm serves: that of its last successful run."""
    return (
        runs.where(F.col("outcome") == "success")
        .groupBy("channel_id", "algo_id")
        .agg(F.max_by("version", F.col("version").cast("bigint")).alias("version"))
    )


def next_version(spark: SparkSession, root: str, channel: str, algo: str) -> str:
    """One after the last successful version; a failed run's number is used again."""
    runs = read_runs(spark, root).where(
        (F.col("channel_id") == channel)
        & (F.col("algo_id") == algo)
        & (F.col("outcome") == "success")
    )
    following = F.coalesce(F.max(F.col("version").cast("bigint")), F.lit(0)) + 1
    return runs.agg(keys.padded(following).alias("version")).first()["version"]


def _claim(root: str, channel: str, algo: str, number: int) -> str:
    names = (quote(name, safe="") for name in (channel, algo, str(number)))
    return "/".join([root, "claims", *names])


def claim_version(spark: SparkSession, root: str, channel: str, algo: str) -> str:
    """Take the next version for a run of its own: of two runs at once one gets the number after."""
    number = int(next_version(spark, root, channel, algo))
    while not files.claim(spark, _claim(root, channel, algo, number)):
        number += 1
    return f"{number:0{keys.PAD_WIDTH}}"


def release_version(spark: SparkSession, root: str, channel: str, algo: str, version: str) -> None:
    """Give a version back after its run failed, so that the next run takes it."""
    files.delete(spark, _claim(root, channel, algo, int(version)))


def current_results(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Results of the current versions only.

    The versions are one row per algorithm. Where Spark broadcasts them, they prune the
    partition folders of older versions at run time.
    """
    versions = current_versions(read_runs(spark, root))
    return read_results(spark, root, kind).join(
        versions, ["channel_id", "algo_id", "version"]
    )
