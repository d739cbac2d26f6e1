"""Moving objects: valid fixes, one fix per object, bounded trails, thinning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import geo
from tidewatch.functions import vocabulary as V
from tidewatch.functions.staging import materialize
from tidewatch.operators.numbering import top_per

# Order of the fields in one state vector.
STATE_FIELDS = (
    "icao24", "callsign", "origin_country", "time_position", "last_contact", "lon", "lat",
    "baro_altitude", "on_ground", "velocity", "true_track",
)
MIN_STATE_FIELDS = 12


def state_columns(vector: Column) -> list[Column]:
    """Named text columns of an ``array<string>`` state vector."""
    return [F.get(vector, F.lit(i)).alias(name) for i, name in enumerate(STATE_FIELDS)]


def valid_fixes(states: DataFrame, clock_ms: Column) -> DataFrame:
    """Normalized fixes; anything unusable, stale or ahead of the clock is dropped.

    ``states`` has the text columns of :func:`state_columns`, ``n_fields`` and ``pos``
    (input order); ``clock_ms`` is the batch clock, not the wall clock.
    """
    # Each field is read several times by the checks, so it is parsed once per row.
    parsed = materialize(
        states.withColumn("clock", clock_ms),
        {
            "x": F.expr("try_cast(lon AS DOUBLE)"),
            "y": F.expr("try_cast(lat AS DOUBLE)"),
            "alt": F.expr("CASE WHEN baro_altitude IS NULL THEN -90.0D ELSE try_cast(baro_altitude AS DOUBLE) END"),
            "velo": F.expr("CASE WHEN velocity IS NULL THEN 0.0D ELSE try_cast(velocity AS DOUBLE) END"),
            "track": F.expr("CASE WHEN true_track IS NULL THEN 0.0D ELSE try_cast(true_track AS DOUBLE) END"),
            "contact_ms": F.expr("CAST(try_cast(last_contact AS DOUBLE) AS BIGINT) * 1000"),
            "ident": F.expr("lower(trim(icao24))"),
        },
    )
    # Comparisons with null or NaN are not true (NaN sorts above every number), so finiteness needs no test of its own
    # beyond an upper bound.
    usable = f"""
      n_fields >= {MIN_STATE_FIELDS} AND abs(alt) < double('Infinity') AND abs(velo) < double('Infinity')
      AND abs(track) < double('Infinity') AND alt >= {V.FIX_MIN_ALT_M} AND contact_ms > 0
      AND clock - contact_ms BETWEEN -{V.FIX_MAX_AHEAD_MS} AND {V.FIX_MAX_AGE_MS}"""
    anonymous = "'anon-' || CAST(pmod(xxhash64(x, y), 100000000) AS STRING)"
    return parsed.filter(F.expr(usable) & geo.valid_coordinates(F.col("y"), F.col("x"))).select(
        "pos",
        F.expr(f"substring(CASE WHEN coalesce(ident, '') = '' THEN {anonymous} ELSE ident END, 1, 9)").alias("id"),
        F.expr("nullif(substring(trim(callsign), 1, 16), '')").alias("callsign"),
        F.expr("nullif(substring(origin_country, 1, 24), '')").alias("country"),
        F.bround("x", 4).alias("lon"),
        F.bround("y", 4).alias("lat"),
        F.bround("alt", 0).cast("int").alias("alt_m"),
        F.nullif(F.bround("velo", 1), F.lit(0.0)).alias("speed"),
        geo.heading(F.col("track")).alias("heading"),
        "clock",
    )


def best_fix(fixes: DataFrame, *keys: str) -> DataFrame:
    """Highest fix per object (and further keys, such as the cycle); equal heights keep the first."""
    return top_per(fixes, ["id", *keys], 1, F.col("alt_m").desc(), F.col("pos").asc()).drop("rank")


@dataclass(frozen=True)
class TrailPolicy:
    """Bounds of a published trail. One fix per object and cycle, so a trail holds
    at most ``max_age_ms / cycle`` candidates whatever the size of the input."""

    points: int = V.TRAIL_POINTS
    max_age_ms: int = V.TRAIL_MAX_AGE_MS
    min_move: float = V.TRAIL_MIN_MOVE_DEG

    def extend(self, trail: Column, lon: Column, lat: Column, clock: Column) -> Column:
        """The trail after one fix: expire old points, append if moved or stale, keep the last ones."""
        alive = F.filter(trail, lambda p: p.ts >= clock - self.max_age_ms)
        kept = self._tail(alive)
        last = F.get(kept, F.size(kept) - 1)
        moved = (F.abs(last.lon - lon) > self.min_move) | (F.abs(last.lat - lat) > self.min_move)
        stale = clock - last.ts >= self.max_age_ms // 8
        point = F.array(F.struct(lon.alias("lon"), lat.alias("lat"), clock.alias("ts")))
        return F.when(last.isNull() | moved | stale, self._tail(F.concat(kept, point))).otherwise(kept)

    def _tail(self, points: Column) -> Column:
        return F.slice(points, F.greatest(F.size(points) - self.points + 1, F.lit(1)), F.lit(self.points))


TRAIL = "array<struct<lon:double,lat:double,ts:bigint>>"


def update_trails(current: DataFrame, previous: DataFrame, policy: TrailPolicy | None = None) -> DataFrame:
    """One cycle: current best fixes continue their previous trail; objects not seen now are gone.

    ``previous`` has one row per id (``id, trail``), so the join cannot fan out.
    """
    policy = policy or TrailPolicy()
    before = F.coalesce(F.col("trail"), F.array().cast(TRAIL))
    joined = current.join(previous.select("id", "trail"), "id", "left")
    # The old trail is a column of its own before it is rewritten: extend() reads it several times.
    return joined.withColumn("trail", before).withColumn(
        "trail", policy.extend(F.col("trail"), F.col("lon"), F.col("lat"), F.col("clock"))
    )


def fold_trails(cycle_fixes: DataFrame, as_of_ms: int, policy: TrailPolicy | None = None) -> DataFrame:
    """Trails at ``as_of`` folded from one fix per (id, clock) within the trail horizon.

    ``cycle_fixes`` must come from :func:`best_fix` per cycle: the array collected per
    object is then bounded by the cycles inside ``max_age_ms``, not by its traffic.
    """
    policy = policy or TrailPolicy()
    horizon = cycle_fixes.filter(F.col("clock").between(as_of_ms - policy.max_age_ms, as_of_ms))
    points = horizon.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("clock", "lon", "lat"))).alias("steps"))
    trail = F.aggregate(
        "steps", F.array().cast(TRAIL), lambda acc, p: policy.extend(acc, p.lon, p.lat, p.clock)
    )
    return points.select("id", trail.alias("trail"))


def rank_trails(trails: DataFrame, limit: int, pinned: str | None = None) -> DataFrame:
    """Newest then longest trails with at least two points; a pinned trail replaces the last."""
    first, last = F.get("trail", F.lit(0)), F.element_at("trail", -1)
    measured = trails.filter(F.size("trail") >= 2).select(
        "id",
        F.array_max(F.transform("trail", lambda p: p.ts)).alias("newest"),
        geo.haversine_km(first.lon, first.lat, last.lon, last.lat).alias("moved_km"),
    )
    order = [F.col("newest").desc(), F.col("moved_km").desc(), F.col("id").asc()]
    if pinned is None:
        return measured.orderBy(*order).limit(limit)
    # The pinned trail takes a place even when it would not earn one.
    return measured.orderBy((F.col("id") == pinned).desc(), *order).limit(limit)


def zoom_tier(height_m: float) -> tuple:
    """(max height, trails, fixes per trail, aircraft, grid degrees) for a camera height."""
    return next(tier for tier in V.ZOOM_TIERS if tier[0] is None or height_m <= tier[0])


def thin_grid(fixes: DataFrame, grid_deg: float, limit: int, pinned: str | None = None) -> DataFrame:
    """First object per grid cell in input order, the pinned one always, at most ``limit`` in all."""
    cell = F.struct(
        F.floor((F.col("lon") + 180) / grid_deg).alias("x"), F.floor((F.col("lat") + 90) / grid_deg).alias("y")
    )
    is_pinned = F.lit(False) if pinned is None else F.coalesce(F.col("id") == pinned, F.lit(False))
    flagged = fixes.withColumns({"cell": cell, "pinned": is_pinned})
    # The pinned object occupies no cell: it is set aside before the cells are filled.
    cells = top_per(flagged.filter(~F.col("pinned")), ["cell"], 1, F.col("pos").asc()).drop("rank")
    shown = cells if pinned is None else cells.unionByName(flagged.filter("pinned"))
    return shown.orderBy(F.col("pinned").desc(), F.col("pos").asc()).limit(limit).drop("cell")


def by_altitude(fixes: DataFrame) -> DataFrame:
    return fixes.orderBy(F.coalesce("alt_m", F.lit(0)).desc(), F.col("pos").asc())
