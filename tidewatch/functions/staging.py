"""Computing expensive columns once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def materialize(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later steps may read and filter on freely.

    The optimizer pushes a filter below a plain projection by copying the projected
    expressions into it; for chains of regular expressions the copies multiply. A
    one-row ``inline`` is a narrow, code-generated step that filters are not pushed
    through, so every expression is evaluated exactly once.
    """
    row = F.struct(*(value.alias(name) for name, value in columns.items()))
    return df.select("*", F.inline_outer(F.array(row)))


# A noncharacter, so it cannot be text; any stray one is replaced by its neighbour of equal length.
_MARK, _STRAY = "\uffff", "\ufffe"


def marked_split(text: Column, pattern: str) -> Column:
    """Cut a text into ``[gap, match, gap, match, …, gap]`` with a single pass of the pattern."""
    clean = F.replace(text, F.lit(_MARK), F.lit(_STRAY))
    return F.split(F.regexp_replace(clean, F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)


def matches_of(pieces: str) -> Column:
    return F.expr(f"filter({pieces}, (p, i) -> i % 2 = 1)")


def gaps_of(pieces: str) -> Column:
    return F.expr(f"filter({pieces}, (p, i) -> i % 2 = 0)")


def spread(df: DataFrame) -> DataFrame:
    """Redistribute an input that the scan split into fewer tasks than there are cores.

    Only an input of few row groups is affected; a large table already has more splits
    than cores and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
