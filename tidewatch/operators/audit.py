"""Re-deriving locations of stored events: the offline re-audit and the fail-closed publication check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.places_text import Gazetteer, locate

TOLERANCE = 1e-6


def _rederived(events: DataFrame, gazetteer: Gazetteer | None) -> DataFrame:
    """Adds ``expected``. A lede location only stands for rows that came from their lede."""
    untrusted = F.coalesce(F.col("geo_source"), F.lit("")) != "source"
    found = locate(events, "title", "summary", "expected", when=untrusted, gazetteer=gazetteer)
    usable = (F.col("expected.source") == "title") | (F.col("geo_source") == "summary")
    return found.withColumn("expected", F.when(usable, F.col("expected")))


def _agrees() -> Column:
    near = (F.abs(F.col("lat") - F.col("expected.lat")) < TOLERANCE) & (
        F.abs(F.col("lon") - F.col("expected.lon")) < TOLERANCE
    )
    return F.coalesce(near, F.lit(False))


def geo_violations(events: DataFrame, gazetteer: Gazetteer | None = None) -> DataFrame:
    """Events whose coordinates their own text does not support; any row blocks publication."""
    checked = _rederived(events, gazetteer)
    return checked.filter((F.coalesce(F.col("geo_source"), F.lit("")) != "source") & ~_agrees())


def geo_audit(events: DataFrame, gazetteer: Gazetteer | None = None) -> DataFrame:
    """Every event with its action and the location after it.

    ``preservedSource``, ``unchanged``, ``updated`` or ``quarantined`` (no single
    supported place any more; the old coordinates are not trusted).
    """
    action = (
        F.when(F.col("geo_source") == "source", "preservedSource")
        .when(F.col("expected").isNull(), "quarantined")
        .when(_agrees() & (F.col("loc") == F.col("expected.loc")), "unchanged")
        .otherwise("updated")
    )
    audited = _rederived(events, gazetteer).withColumn("action", action)
    moved = F.col("action") == "updated"
    return audited.withColumns(
        {
            "new_lat": F.when(moved, F.col("expected.lat")).otherwise(F.col("lat")),
            "new_lon": F.when(moved, F.col("expected.lon")).otherwise(F.col("lon")),
            "new_loc": F.when(moved, F.col("expected.loc")).otherwise(F.col("loc")),
        }
    ).drop("expected")
