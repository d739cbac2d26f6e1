"""Geometry as Column expressions: distance, boxes, rings, headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions import vocabulary as V


def valid_coordinates(lat: Column, lon: Column) -> Column:
    """Both present, in range, and not the 0/0 placeholder. Never null."""
    ok = lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
    return F.coalesce(ok, F.lit(False))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * V.EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def wrap_degrees(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def unwrap_around(lon: Column, center: Column) -> Column:
    """Longitude moved next to ``center`` so that min/max work across the seam."""
    return center + F.pmod(lon - center + 540, F.lit(360.0)) - 180


def box_circle(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Struct(lat, lon, radius_km) of the circle around a box; west > east crosses the seam."""
    lat = (south + north) / 2
    span = F.when(west > east, F.pmod(east - west, F.lit(360.0))).otherwise(east - west)
    lon = wrap_degrees(west + span / 2)
    height = F.abs(north - south) * 111.0
    width = span * 111.0 * F.cos(F.radians(lat))
    radius = F.greatest(F.lit(50), F.floor(F.hypot(height, width) / 2).cast("int"))
    return F.struct(lat.alias("lat"), lon.alias("lon"), radius.alias("radius_km"))


def ring_contains(ring: Column, lon: Column, lat: Column) -> Column:
    """Even-odd test of a point against an array of struct(lon, lat) vertices."""
    n = F.size(ring)

    def flip(inside: Column, i: Column) -> Column:
        a = F.get(ring, i)
        b = F.get(ring, F.when(i == 0, n - 1).otherwise(i - 1))
        straddles = (a.lat > lat) != (b.lat > lat)
        crossing = (b.lon - a.lon) * (lat - a.lat) / F.nullif(b.lat - a.lat, F.lit(0.0)) + a.lon
        return inside != F.coalesce(straddles & (lon < crossing), F.lit(False))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), flip)


def ring_box(ring: Column) -> Column:
    lons, lats = F.transform(ring, lambda p: p.lon), F.transform(ring, lambda p: p.lat)
    return F.struct(
        F.array_min(lons).alias("west"),
        F.array_min(lats).alias("south"),
        F.array_max(lons).alias("east"),
        F.array_max(lats).alias("north"),
    )


def split_at_seam(ring: Column) -> Column:
    """Cut a closed ring wherever an edge crosses ±180, adding the seam point on both sides.

    Returns an array of rings. Pieces keep their order along the outline, and
    pieces with fewer than three points are dropped; open pieces are closed.
    """
    point = "struct<lon:double,lat:double>"
    state0 = F.struct(
        F.array().cast(f"array<array<{point}>>").alias("done"),
        F.array(F.get(ring, F.lit(0))).cast(f"array<{point}>").alias("open"),
    )

    def vertex(lon: Column, lat: Column) -> Column:
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    def step(state: Column, b: Column) -> Column:
        a = F.element_at(state.open, -1)
        short_way = F.pmod(b.lon - a.lon + 540, F.lit(360.0)) - 180
        seam = F.when(a.lon > 0, F.lit(180.0)).otherwise(F.lit(-180.0))
        seam_lat = F.round(a.lat + (seam - a.lon) / short_way * (b.lat - a.lat), 4)
        crossed = F.struct(
            F.concat(state.done, F.array(F.concat(state.open, F.array(vertex(seam, seam_lat))))).alias("done"),
            F.array(vertex(-seam, seam_lat), b).alias("open"),
        )
        grown = F.struct(state.done.alias("done"), F.concat(state.open, F.array(b)).alias("open"))
        return F.when(F.abs(b.lon - a.lon) > 180, crossed).otherwise(grown)

    def close(piece: Column) -> Column:
        first, last = F.get(piece, F.lit(0)), F.element_at(piece, -1)
        closed = (first.lon == last.lon) & (first.lat == last.lat)
        return F.when(closed, piece).otherwise(F.concat(piece, F.array(first)))

    rest = F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0)))
    pieces = F.aggregate(rest, state0, step, lambda s: F.concat(s.done, F.array(s.open)))
    return F.transform(F.filter(pieces, lambda p: F.size(p) >= 3), close)


def heading(degrees: Column) -> Column:
    """0..360 with one decimal; zero or missing is null."""
    value = F.nullif(degrees, F.lit(0.0))
    return F.bround(F.pmod(value, F.lit(360.0)), 1)
