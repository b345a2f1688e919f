"""Tables that are fed in batches, read and compacted at the same time.

    batches/<table>/attempt=…/…          what one attempt at a batch wrote, never changed again
    commits/<rule>/<source>/<batch>.<attempt>
                                         an empty file: that attempt is the batch
    merged/<table>/…/bucket=…/generation=…
                                         what committed batches were merged into
    generations/<number>                 which bucket lies in which generation, and which batches
                                         these hold

A batch goes to several tables and becomes visible in all of them at once, with its commit. Readers
take the newest generation and every committed batch that it doesn't hold, so they see the same rows
before, during and after a compaction. Compacting reads only the batches that are not merged yet and
the buckets they touch; other buckets stay where they are. The new generation is claimed by creating
its file, which only one of several can do; what a loser wrote is not part of any generation. A batch
that is written again after it was merged is known by its number and counts once.

What a batch's number means is the rule of its source:

* ``EACH``: batches are numbered 0, 1, …, and every one counts (streams);
* ``LATEST``: a later batch replaces all earlier ones of the source (uploads loaded again);
* ``ONCE``: a single batch (rows that are appended).

Files that no reader needs any more are deleted by ``clean`` alone, after a time in which readers that
began earlier end.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.sources import files

EACH, LATEST, ONCE = "each", "latest", "once"
OWNER = "owner"  # the source of rows that a later batch may replace, else NULL
BUCKET = "bucket string, generation string"


@dataclass(frozen=True)
class Table:
    """How a batched table is laid out.

    ``bucket`` names the part of the table that a row belongs to: a compaction rewrites whole parts.
    ``merge`` turns the rows of some parts into fewer that mean the same; it must keep the rows of
    different owners apart.
    """

    name: str
    schema: str
    bucket: Callable[[], Column]
    merge: Callable[[DataFrame], DataFrame] = lambda rows: rows
    partitions: tuple[str, ...] = ("channel_id",)
    order: tuple[str, ...] = ()

    @property
    def parts(self) -> list[str]:
        return [*self.partitions, "bucket"]


@dataclass(frozen=True, order=True)
class Commit:
    rule: str
    source: str
    batch: int
    attempt: str

    @property
    def owner(self) -> str | None:
        return self.source if self.rule == LATEST else None

    @property
    def key(self) -> str:
        return f"{self.rule}/{quote(self.source, safe='')}"

    @property
    def path(self) -> str:
        return f"commits/{self.key}/{self.batch:012}.{self.attempt}"


@dataclass(frozen=True)
class Generation:
    """What is merged: the generation of every bucket of every table, and the batches in there."""

    number: int = 0
    buckets: dict[str, dict[str, str]] = field(default_factory=dict)
    upto: dict[str, int] = field(default_factory=dict)  # last batch of each source
    once: frozenset[str] = frozenset()  # attempts of sources with a single batch

    def holds(self, commit: Commit) -> bool:
        if commit.rule == ONCE:
            return commit.attempt in self.once
        return commit.batch <= self.upto.get(commit.key, -1)


def write(
    outputs: Mapping[Table, DataFrame], root: str, source: str, batch: int, rule: str = EACH
) -> None:
    """Write one batch to some tables and commit it.

    An attempt has folders of its own, so what a failed or repeated one left does no harm.
    """
    attempt = uuid.uuid4().hex
    spark = next(iter(outputs.values())).sparkSession
    commit = Commit(rule, source, batch, attempt)
    for table, rows in outputs.items():
        owned = rows.withColumn(OWNER, F.lit(commit.owner).cast("string"))
        folder = f"{root}/batches/{table.name}/attempt={attempt}"
        owned.write.partitionBy(*table.partitions).parquet(folder)
    files.claim(spark, f"{root}/{commit.path}")


def is_committed(spark: SparkSession, root: str, source: str, batch: int, rule: str = EACH) -> bool:
    """Whether a batch counts, merged or not."""
    commits = _commits(spark, root)
    asked = Commit(rule, source, batch, "")
    if any((commit.key, commit.batch) == (asked.key, batch) for commit in commits):
        return True
    return current(spark, root).holds(asked)


def next_batch(spark: SparkSession, root: str, source: str) -> int:
    """The number of a source's next batch, where its batches replace each other."""
    own = [commit.batch for commit in _commits(spark, root) if (commit.rule, commit.source) == (LATEST, source)]
    upto = current(spark, root).upto.get(Commit(LATEST, source, 0, "").key, -1)
    return 1 + max([upto, *own])


def _all_commits(spark: SparkSession, root: str) -> list[tuple[Commit, int]]:
    """Every commit that was not cleaned away, repeated attempts included, and when it was made."""
    out = []
    for path, changed in files.listed(spark, f"{root}/commits"):
        rule, source, name = path.split("/")
        batch, attempt = name.split(".")
        out.append((Commit(rule, unquote(source), int(batch), attempt), changed))
    return sorted(out)


def _commits(spark: SparkSession, root: str) -> list[Commit]:
    """One attempt of each committed batch. Attempts at one batch wrote the same rows; in the order
    of their names the first one counts."""
    found: dict[tuple, Commit] = {}
    for commit, _ in _all_commits(spark, root):
        found.setdefault((commit.key, commit.batch), commit)
    return list(found.values())


def current(spark: SparkSession, root: str) -> Generation:
    """The newest generation that is written to its end."""
    for path, _ in reversed(files.listed(spark, f"{root}/generations")):
        try:
            told = json.loads(files.read(spark, f"{root}/generations/{path}"))
        except ValueError:
            continue  # claimed, not written yet or never
        return Generation(int(path), told["buckets"], told["upto"], frozenset(told["once"]))
    return Generation()


def loose(spark: SparkSession, root: str, generation: Generation) -> list[Commit]:
    """The batches that count and are not merged."""
    commits = [commit for commit in _commits(spark, root) if not generation.holds(commit)]
    last = {commit.key: commit.batch for commit in sorted(commits)}
    return [c for c in commits if c.rule != LATEST or c.batch == last[c.key]]


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _part_name(table: Table) -> Column:
    """A bucket's name: its partition values and bucket, escaped and joined."""
    parts = [F.url_encode(F.coalesce(F.col(name), F.lit(""))) for name in table.parts]
    return F.concat_ws("/", *parts)


def _of_batches(spark: SparkSession, root: str, table: Table, commits: list[Commit]) -> DataFrame | None:
    """Rows of some batches; only their folders are read."""
    schema = f"{table.schema}, {OWNER} string, attempt string"
    rows = _stored(spark, f"{root}/batches/{table.name}", schema) if commits else None
    if rows is None:
        return None
    return rows.where(F.col("attempt").isin([commit.attempt for commit in commits])).drop("attempt")


def _of_buckets(
    spark: SparkSession, root: str, table: Table, buckets: Mapping[str, str], replaced: list[str]
) -> DataFrame | None:
    """Rows of some buckets, without those of owners that a later batch replaced."""
    schema = f"{table.schema}, {OWNER} string, {BUCKET}"
    rows = _stored(spark, f"{root}/merged/{table.name}", schema) if buckets else None
    if rows is None:
        return None
    # Partition columns alone, so this only picks folders.
    wanted = [f"{name}/{generation}" for name, generation in buckets.items()]
    rows = rows.where(F.concat_ws("/", _part_name(table), "generation").isin(wanted))
    if replaced:
        rows = rows.where(F.col(OWNER).isNull() | ~F.col(OWNER).isin(replaced))
    return rows.drop("bucket", "generation")


def _replaced(generation: Generation, commits: list[Commit]) -> list[str]:
    """Owners whose merged rows a loose batch replaces."""
    return [c.source for c in commits if c.rule == LATEST and c.key in generation.upto]


def read(
    spark: SparkSession, root: str, table: Table, parts: Sequence[str] | None = None
) -> DataFrame:
    """All rows of a table: merged ones and those of batches that are not merged.

    With ``parts`` only the rows of these buckets, of whatever partition.
    """
    generation = current(spark, root)
    commits = loose(spark, root, generation)
    schema = T.StructType.fromDDL(table.schema)
    merged = generation.buckets.get(table.name, {})
    if parts is not None:
        wanted = {quote(part, safe="") for part in parts}
        merged = {name: where for name, where in merged.items() if name.rsplit("/", 1)[-1] in wanted}
    found = (
        _of_buckets(spark, root, table, merged, _replaced(generation, commits)),
        _of_batches(spark, root, table, commits),
    )
    rows = [part.select(schema.names) for part in found if part is not None]
    if parts is not None:
        rows = [frame.where(table.bucket().isin(list(parts))) for frame in rows]
    return reduce(DataFrame.unionByName, rows) if rows else spark.createDataFrame([], schema)


def compact(spark: SparkSession, root: str, tables: list[Table]) -> int | None:
    """Merge all loose batches into a new generation; returns its number.

    Streams and uploads may go on writing meanwhile, and readers reading. None if there was nothing
    to merge, or if another compaction was faster: then this one has changed nothing.
    """
    old = current(spark, root)
    commits = loose(spark, root, old)
    if not commits:
        return None
    number = 1 + max([old.number, *(int(path) for path, _ in files.listed(spark, f"{root}/generations"))])
    name = f"{number:012}-{uuid.uuid4().hex[:8]}"
    replaced = _replaced(old, commits)
    buckets = {
        table.name: _merge(spark, root, table, old, commits, replaced, name) for table in tables
    }
    upto = dict(old.upto)
    for commit in commits:
        if commit.rule != ONCE:
            upto[commit.key] = max(commit.batch, upto.get(commit.key, -1))
    # Of batches whose commits are gone nothing has to be known.
    there = {c.attempt for c in _commits(spark, root) if c.rule == ONCE}
    once = sorted((old.once & there) | {c.attempt for c in commits if c.rule == ONCE})
    told = json.dumps({"buckets": buckets, "upto": upto, "once": once})
    return number if files.claim(spark, f"{root}/generations/{number:012}", told) else None


def _merge(
    spark: SparkSession,
    root: str,
    table: Table,
    old: Generation,
    commits: list[Commit],
    replaced: list[str],
    name: str,
) -> dict[str, str]:
    """Write the touched buckets of a table anew; returns where all its buckets are."""
    before = old.buckets.get(table.name, {})
    schema = f"{table.schema}, {OWNER} string, {BUCKET}"
    part = _part_name(table).alias("part")

    def parts_of(rows: DataFrame) -> set[str]:
        return {row["part"] for row in rows.select(part).distinct().collect()}

    new = _of_batches(spark, root, table, commits)
    touched = parts_of(new.withColumn("bucket", table.bucket())) if new is not None else set()
    stored = _stored(spark, f"{root}/merged/{table.name}", schema) if replaced and before else None
    if stored is not None:
        touched |= parts_of(stored.where(F.col(OWNER).isin(replaced))) & before.keys()
    kept = {bucket: where for bucket, where in before.items() if bucket not in touched}
    again = {bucket: where for bucket, where in before.items() if bucket in touched}
    rows = [r for r in (_of_buckets(spark, root, table, again, replaced), new) if r is not None]
    if not touched or not rows:
        return before
    merged = table.merge(reduce(DataFrame.unionByName, rows)).withColumns(
        {"bucket": table.bucket(), "generation": F.lit(name)}
    )
    (
        merged.hint("rebalance", *table.parts)
        .sortWithinPartitions(*table.parts, *table.order)
        .write.partitionBy(*table.parts, "generation")
        .mode("append")
        .parquet(f"{root}/merged/{table.name}")
    )
    # A bucket that lost all its rows is not listed.
    written = _stored(spark, f"{root}/merged/{table.name}", schema)
    return kept | dict.fromkeys(parts_of(written.where(F.col("generation") == name)), name)


def clean(spark: SparkSession, root: str, tables: list[Table], older_than_ms: int = 86_400_000) -> int:
    """Delete what the newest generation made needless and is older than a day, or as given: merged
    batches with their commits, and buckets of earlier generations. Returns the number of folders."""
    generation = current(spark, root)
    limit = int(time.time() * 1000) - older_than_ms
    commits = _all_commits(spark, root)
    known = {commit.attempt for commit, _ in commits}
    merged = [commit for commit, changed in commits if changed <= limit and generation.holds(commit)]
    number = 0
    for table in tables:
        folder = f"{root}/batches/{table.name}"
        changes = {
            name.removeprefix("attempt="): changed for name, changed, _ in files.children(spark, folder)
        }
        # An attempt without a commit failed, or is still being written.
        failed = {attempt for attempt, changed in changes.items() if attempt not in known and changed <= limit}
        needless = changes.keys() & ({commit.attempt for commit in merged} | failed)
        paths = [f"{folder}/attempt={attempt}" for attempt in needless]
        needed = set(generation.buckets.get(table.name, {}).values())
        for path, changed in files.listed(spark, f"{root}/merged/{table.name}"):
            bucket, found, name = path.rpartition("/")[0].partition("generation=")
            # A later generation may be being written.
            past = found and int(name.split("-")[0]) <= generation.number
            if past and name not in needed and changed <= limit:
                paths.append(f"{root}/merged/{table.name}/{bucket}{found}{name}")
        for path in set(paths):
            files.delete(spark, path)
            number += 1
    # Commits go last: a batch without a commit isn't read, one without its folders would be missed.
    for commit in merged:
        files.delete(spark, f"{root}/{commit.path}")
    return number
