"""Dense numbering in arrival order that no single task has to see whole.

Rows are cut into a fixed number of order ranges by quantiles of the order column; the ranges are counted with
map-side combine, and each row adds its rank inside its range to the rows of
the earlier ranges. A hot key is spread over all ranges it occurs in.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_RANGES, STRETCH = 4096, 64


@dataclass(frozen=True)
class OrderSpan:
    """Extent of a unique integer order column, cut into ranges.

    ``cuts`` are ascending range starts, drawn from a quantile sketch, so that outliers and clustered values do not
    fill single ranges; without them the extent is cut into ``ranges`` equal widths.
    """

    column: str
    low: int
    high: int
    ranges: int = 1024
    cuts: tuple[int, ...] = ()

    def __post_init__(self):
        if not 1 <= self.ranges <= MAX_RANGES:
            raise ValueError(f"ranges must be 1..{MAX_RANGES}: {self.ranges}")

    @classmethod
    def of(cls, df: DataFrame, column: str, ranges: int = 1024) -> OrderSpan:
        """One narrow pass over the order column."""
        shares = [i / ranges for i in range(ranges + 1)]
        found = df.select(F.col(column).cast("double").alias("x")).approxQuantile("x", shares, 1 / (4 * ranges))
        if not found:
            return cls(column, 0, 0, ranges)
        low, high, cuts = int(found[0]), int(found[-1]), sorted({int(x) for x in found[1:-1]})
        # Evenly spread values need no search: equal widths hold nearly equal shares of them.
        width = max(1, -(-(high - low + 1) // ranges))
        fullest = max(Counter((x - low) // width for x in cuts).values(), default=0)
        return cls(column, low, high, ranges, () if fullest <= 2 else tuple(cuts))

    def bucket(self) -> Column:
        if not self.cuts:
            width = max(1, -(-(self.high - self.low + 1) // self.ranges))
            return F.floor((F.col(self.column) - F.lit(self.low)) / F.lit(width)).cast("long")
        # Two steps of a search tree: first among every 64th cut, then inside that stretch.
        value, stretches = F.col(self.column), [self.cuts[i : i + STRETCH] for i in range(0, len(self.cuts), STRETCH)]
        starts = F.array(*(F.lit(s[0]).cast("long") for s in stretches))
        passed = F.size(F.filter(starts, lambda x: x <= value))
        inside = F.array(F.array().cast("array<bigint>"), *(F.array(*(F.lit(x).cast("long") for x in s)) for s in stretches))
        more = F.size(F.filter(F.get(inside, passed), lambda x: x <= value))
        return (F.greatest(passed - 1, F.lit(0)) * STRETCH + more).cast("long")


def number(df: DataFrame, span: OrderSpan, out: str, *, start: int = 1) -> DataFrame:
    """Add ``out`` = start, start+1, … following the span's order column over the whole table."""
    ranged = df.withColumn("__range", span.bucket())
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # At most ``ranges`` rows, so both the window and the broadcast are bounded.
    offsets = ranged.groupBy("__range").count().select(
        "__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy("__range").orderBy(span.column)
    return (
        ranged.withColumn("__rank", F.row_number().over(inside))
        .join(F.broadcast(offsets), "__range")
        .withColumn(out, F.col("__before") + F.col("__rank") + F.lit(start - 1))
        .drop("__range", "__rank", "__before")
    )


def number_within(df: DataFrame, keys: Sequence[str], span: OrderSpan, out: str) -> DataFrame:
    """Add ``out`` = 1, 2, … per key in order. Keys must not be null."""
    ranged = df.withColumn("__range", span.bucket())
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*keys, "__range").count().select(
        *keys, "__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy(*keys, "__range").orderBy(span.column)
    return (
        ranged.withColumn("__rank", F.row_number().over(inside))
        .join(offsets, [*keys, "__range"])
        .withColumn(out, F.col("__before") + F.col("__rank"))
        .drop("__range", "__rank", "__before")
    )


def first_per(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """First row per key. Spark cuts each map task to one row per key before the shuffle."""
    return top_per(df, keys, 1, *order).drop("rank")


def top_per(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    """First ``n`` rows per key with their ``rank``; the order must be total."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)
