"""What a registered query is."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    """A Spark query over a folder of test tables, and SQL with the same result if there is."""

    build: Build
    sql: str | None = None


class Registry(dict[str, Query]):
    def add(self, sql: str | None = None, name: str | None = None):
        """Register the decorated function under its own name or the given one."""

        def register(build: Build) -> Build:
            self[name or build.__name__] = Query(build, sql)
            return build

        return register
