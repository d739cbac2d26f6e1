"""Trails of a stream of fixes, kept as a table that each micro-batch replaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidewatch.operators.tracks import TRAIL, TrailPolicy
from tidewatch.session import drop_folder

_SCHEMA = f"id string, clock bigint, trail {TRAIL}"


def trails_path(root: str, batch_id: int) -> str:
    return f"{root}/batch-{batch_id:012d}"


def advance_trails(fixes: DataFrame, root: str, batch_id: int, policy: TrailPolicy | None = None) -> None:
    """Write the trails after one micro-batch from those after the batch before.

    Cycles of the batch follow each other by clock; their number is bounded by what the batch covers. Each object's fixes, one
    per cycle, are folded onto its trail in one grouped pass, however many cycles there are; an object that a cycle does not see loses its trail,
    and one that the last cycle does not see is dropped. A repeated batch writes the same folder again, so a restart
    changes nothing; the folder two batches back is no longer needed and goes.
    """
    spark, policy, empty = fixes.sparkSession, policy or TrailPolicy(), F.array().cast(TRAIL)
    trails = spark.read.schema(_SCHEMA).parquet(trails_path(root, batch_id - 1)) if batch_id else spark.createDataFrame([], _SCHEMA)
    clocks = [r.clock for r in fixes.select("clock").distinct().orderBy("clock").collect()]
    if clocks:
        number = F.array_position(F.array(*(F.lit(c).cast("long") for c in clocks)), F.col("clock"))
        steps = fixes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(number.alias("at"), "clock", "lon", "lat"))).alias("steps"))
        seen = steps.filter(F.element_at("steps", -1).at == len(clocks)).join(trails.select("id", "trail"), "id", "left")

        def follow(acc, p):
            held = F.when(p.at == acc.at + 1, acc.trail).otherwise(empty)
            return F.struct(policy.extend(held, p.lon, p.lat, p.clock).alias("trail"), p.at.alias("at"))

        start = F.struct(F.coalesce("trail", empty).alias("trail"), F.lit(0).cast("long").alias("at"))
        folded = F.aggregate("steps", start, follow, lambda acc: acc.trail)
        trails = seen.select("id", F.lit(clocks[-1]).cast("long").alias("clock"), folded.alias("trail"))
    trails.write.mode("overwrite").parquet(trails_path(root, batch_id))
    if batch_id > 1:
        drop_folder(spark, trails_path(root, batch_id - 2))


def stream_trails(cycle_fixes: DataFrame, root: str, policy: TrailPolicy | None = None, contact: str | None = None) -> DataStreamWriter:
    """A writer that keeps the trail table below ``root`` (a shared folder) up to date. Feed it one fix per object and cycle,
    in batches cut at cycle boundaries. ``contact`` names a time column whose watermark drops late fixes."""
    if contact is not None:
        cycle_fixes = within_clock(cycle_fixes, contact)
    return cycle_fixes.writeStream.foreachBatch(lambda batch, number: advance_trails(batch, root, number, policy))


def within_clock(fixes: DataFrame, contact: str = "last_contact", delay: str = "60 seconds") -> DataFrame:
    """Watermarked fixes; rows ahead of the batch clock are dropped by the fix rules themselves."""
    return fixes.withWatermark(contact, delay)
