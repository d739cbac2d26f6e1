"""Named queries over the parquet tables, each with the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidewatch.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, directory: str) -> DataFrame:
        return self.build(Tables(spark, directory))


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, *, ctes: tuple[str, ...] = ()):
    """Register the decorated function; ``ctes`` are put in front of ``sql``."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        text = None if sql is None else (f"WITH {', '.join(ctes)} {sql}" if ctes else sql)
        QUERIES[name] = Query(build, text)
        return build

    return register
