"""Append-only tables under one folder, committed by a pointer row that is written last.

A writer fills ``<table>/sequence=N`` folders and then adds the pointer
``publications/sequence=N``. Readers only see sequences with a pointer, so a crash
at any point leaves the previous state current, and the next attempt at N
overwrites whatever the crash left.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schemas import TABLES
from tidewatch.session import configure


class Warehouse:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = configure(spark), root.rstrip("/")
        self._last: int | None = None

    def _load(self, table: str) -> DataFrame:
        schema = f"{TABLES[table]}, sequence bigint"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def load(self, table: str, columns: list[str]) -> DataFrame:
        """The given columns and the sequence of every row, committed or not."""
        return self._load(table).select(*columns, "sequence")

    def load_path(self, path: str, table: str, columns: list[str], more: str) -> DataFrame:
        """A folder that holds some columns of a table and the further ones given as DDL."""
        kinds = dict(c.split(" ", 1) for c in _split_ddl(TABLES[table]))
        return self.spark.read.schema(", ".join([*(f"{c} {kinds[c]}" for c in columns), more])).parquet(path)

    def committed(self) -> int:
        """Highest published or pending sequence; 0 before the first."""
        self._last = self._load("publications").agg(F.coalesce(F.max("sequence"), F.lit(0))).first()[0]
        return self._last

    def read(self, table: str, sequence: int | None = None) -> DataFrame:
        """Committed rows of a table, of one sequence or of all; pruned by partition."""
        last = self.committed() if self._last is None else self._last
        wanted = F.col("sequence") <= last if sequence is None else (F.col("sequence") == sequence) & F.lit(sequence <= last)
        return self._load(table).filter(wanted)

    def ledger(self, table: str) -> DataFrame:
        """A ledger that is valid row by row, without waiting for a publication."""
        return self._load(table).drop("sequence")

    def write(self, table: str, rows: DataFrame, sequence: int) -> DataFrame:
        """Write one sequence of a table and return it read back, free of its lineage."""
        columns = columns_of(table)
        path = f"{self.root}/{table}/sequence={sequence}"
        rows.select(*columns).write.mode("overwrite").parquet(path)
        if table == "publications":
            self._last = None
        return self.spark.read.schema(TABLES[table]).parquet(path)

    def append(self, table: str, rows: DataFrame, sequence: int) -> None:
        """Add rows to a sequence (ledger entries: one row per call)."""
        columns = columns_of(table)
        rows.select(*columns).write.mode("append").parquet(f"{self.root}/{table}/sequence={sequence}")

    def row(self, table: str, **values) -> DataFrame:
        """A one-row frame of a ledger table, from literals."""

        def literal(value):
            return F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)

        columns = (c.split(" ", 1) for c in _split_ddl(TABLES[table]))
        return self.spark.range(1).select(*(literal(values[n]).cast(kind).alias(n) for n, kind in columns))


def columns_of(table: str) -> list[str]:
    return [c.split(" ")[0] for c in _split_ddl(TABLES[table])]


def _split_ddl(ddl: str) -> list[str]:
    """Top-level column definitions of a column list."""
    parts, depth, start = [], 0, 0
    for i, char in enumerate(ddl):
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            parts.append(ddl[start:i].strip())
            start = i + 1
    return [*parts, ddl[start:].strip()]


def table_digest(rows: DataFrame) -> Column:
    """Order-independent digest of a table: row count and xor folds of per-row hashes.

    Combines map-side, so the table is never gathered; use it inside ``agg``.
    """
    line = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    folds = (F.bit_xor(F.conv(F.substring(line, i, 15), 16, 10).cast("long")).cast("string") for i in (1, 16, 31, 46))
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), *(F.coalesce(x, F.lit("")) for x in folds)), 256)
