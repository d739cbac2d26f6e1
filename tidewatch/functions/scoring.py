"""Quality, confidence and the corroboration predicate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions import vocabulary as V


def quality(title: Column, domain: Column, tone: Column, image: Column) -> Column:
    """0..100: base 40, readable title 20, known domain 20, strong tone 10, image 10."""
    points = (
        F.lit(40)
        + F.when(F.length(title).between(30, 180), 20).otherwise(0)
        + F.when(F.coalesce(domain, F.lit("")) != "", 20).otherwise(0)
        + F.when(F.abs(tone) >= 3, 10).otherwise(0)
        + F.when(F.coalesce(image, F.lit("")) != "", 10).otherwise(0)
    )
    return F.least(points, F.lit(100)).cast("int")


def confidence(quality_points: Column, outlets: Column, hours_old: Column) -> Column:
    """1..97: base 35 + a fifth of quality + 18 per further outlet (max 40) - age decay (max 25)."""
    base = F.lit(35) + F.bround(quality_points.cast("double") / 5).cast("int")
    diversity = F.least(F.greatest(outlets - 1, F.lit(0)) * 18, F.lit(40)).cast("int")
    decay = F.when(
        hours_old > 6, F.floor(F.least((hours_old - 6) * F.lit(25 / 48), F.lit(25.0))).cast("int")
    ).otherwise(0)
    return F.greatest(F.lit(1), F.least(base + diversity - decay, F.lit(97))).cast("int")


def pulse(n_sources: Column, confidence_points: Column) -> Column:
    """Two or more sources, or high confidence."""
    return (F.coalesce(n_sources, F.lit(0)) >= 2) | (F.coalesce(confidence_points, F.lit(0)) >= 85)


def severity_rank(severity: Column) -> Column:
    """critical 0 … deesc 3."""
    ranks = F.when(severity == V.SEVERITIES[0], 0)
    for rank, name in enumerate(V.SEVERITIES[1:], start=1):
        ranks = ranks.when(severity == name, rank)
    return ranks


def source_tier(name: Column) -> Column:
    tiers = F.create_map(*(F.lit(x) for pair in V.SOURCE_TIERS.items() for x in pair))
    return F.coalesce(F.try_element_at(tiers, F.lower(name)), F.lit(0))
