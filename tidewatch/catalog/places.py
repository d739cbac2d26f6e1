"""Queries: polygons, cities and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog import oracle as O
from tidewatch.catalog.registry import query
from tidewatch.functions import geo
from tidewatch.operators import spatial
from tidewatch.operators.numbering import OrderSpan, number

_NATIONS = O.polygons("nation", "n_nationkey")
_SUPPLIERS = O.polygons("supplier", "s_suppkey")
_INSIDE = """
edges AS (
  SELECT b.polygon_id, a.lon AS alon, a.lat AS alat, b.lon AS blon, b.lat AS blat
  FROM vertices b JOIN vertices a ON a.polygon_id = b.polygon_id AND a.i = b.i + 1),
inside AS (
  SELECT f.pos, e.polygon_id FROM fixes f JOIN edges e
    ON (e.alat > f.lat) <> (e.blat > f.lat) AND f.lon < (e.blon - e.alon) * (f.lat - e.alat) / (e.blat - e.alat) + e.alon
  GROUP BY f.pos, e.polygon_id HAVING count(*) % 2 = 1)
"""


@query(
    "point_in_polygon",
    "SELECT pos AS point_id, min(polygon_id) AS polygon_id FROM inside GROUP BY pos",
    ctes=(O.FIXES, _NATIONS, _INSIDE),
)
def point_in_polygon(t):
    return spatial.points_in_polygons(t.points, t.polygons("nation", "n_nationkey"))


@query(
    "events_per_country",
    """SELECT s.polygon_id, count(p.pos) AS events FROM shapes s
       LEFT JOIN (SELECT pos, min(polygon_id) AS polygon_id FROM inside GROUP BY pos) p ON p.polygon_id = s.polygon_id GROUP BY s.polygon_id""",
    ctes=(O.FIXES, _NATIONS, _INSIDE),
)
def events_per_country(t):
    nations = t.polygons("nation", "n_nationkey")
    placed = spatial.points_in_polygons(t.points, nations).groupBy("polygon_id").agg(F.count("*").alias("n"))
    return nations.select("polygon_id").join(placed, "polygon_id", "left").select(
        "polygon_id", F.coalesce("n", F.lit(0)).alias("events")
    )


@query(
    "polygon_bounds",
    """SELECT polygon_id, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north, round(avg(lon), 6) AS mean_lon,
         round(avg(lat), 6) AS mean_lat, round(degrees(atan2(avg(sin(radians(lon))), avg(cos(radians(lon))))), 6) AS circular_lon
       FROM vertices GROUP BY polygon_id""",
    ctes=(_SUPPLIERS,),
)
def polygon_bounds(t):
    bounds = spatial.polygon_bounds(t.polygons("supplier", "s_suppkey"))
    return bounds.select(
        "polygon_id", "west", "south", "east", "north", F.round("mean_lon", 6).alias("mean_lon"),
        F.round("mean_lat", 6).alias("mean_lat"), F.round("circular_lon", 6).alias("circular_lon"),
    )


@query(
    "region_bbox",
    """SELECT v.polygon_id, round(min(v.lon), 6) AS west, round(max(v.lon), 6) AS east, min(v.lat) AS south, max(v.lat) AS north
       FROM vertices v GROUP BY v.polygon_id""",
    ctes=(_SUPPLIERS,),
)
def region_bbox(t):
    boxes = spatial.region_box(t.polygons("supplier", "s_suppkey"))
    return boxes.select("polygon_id", F.round("west", 6).alias("west"), F.round("east", 6).alias("east"), "south", "north")


@query("city_gazetteer", "SELECT pos, name, iso, population, lon, lat FROM cities", ctes=(O.CITIES,))
def city_gazetteer(t):
    return spatial.gazetteer(t.cities)


@query(
    "nearest_city",
    f"""SELECT pos AS point_id, city_id, round(km, 3) AS km FROM (
          SELECT f.pos, c.pos AS city_id, {O.haversine('f.lon', 'f.lat', 'c.lon', 'c.lat')} AS km,
            row_number() OVER (PARTITION BY f.pos ORDER BY {O.haversine('f.lon', 'f.lat', 'c.lon', 'c.lat')}, c.pos) AS rn
          FROM fixes f JOIN cities c ON pow(c.lon - f.lon, 2) + pow(c.lat - f.lat, 2) <= 0.35 * 0.35
            AND {O.haversine('f.lon', 'f.lat', 'c.lon', 'c.lat')} < 45) WHERE rn = 1""",
    ctes=(O.FIXES, O.CITIES),
)
def nearest_city(t):
    cities = spatial.gazetteer(t.cities).withColumnRenamed("pos", "city_id")
    return spatial.nearest_city(t.points, cities).select("point_id", "city_id", F.round("km", 3).alias("km"))


@query(
    "region_stats",
    f"""SELECT c.pos AS center_id, count(f.pos) AS n FROM cities c
        LEFT JOIN fixes f ON abs(f.lat - c.lat) < 0.2 AND {O.haversine('f.lon', 'f.lat', 'c.lon', 'c.lat')} < 14 GROUP BY c.pos""",
    ctes=(O.FIXES, O.CITIES),
)
def region_stats(t):
    centers = spatial.gazetteer(t.cities).withColumnRenamed("pos", "center_id")
    return spatial.count_within(t.points, centers)


_INDEXED = """indexed AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS index FROM cities)"""


@query(
    "city_lod",
    """SELECT pos, index FROM indexed WHERE population >= 750000 OR (index % 4 = 0 AND population >= 120000) ORDER BY index LIMIT 600""",
    ctes=(O.CITIES, _INDEXED),
)
def city_lod(t):
    cities = spatial.gazetteer(t.cities)
    indexed = number(cities, OrderSpan.of(t.cities, "pos"), "index", start=0)
    return spatial.city_detail(indexed, 1.2e7).select("pos", "index")


@query(
    "split_rings",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS pieces, CAST(CASE WHEN event_id % 2 = 0 THEN 180 ELSE 0 END AS DOUBLE) AS seam FROM events""",
)
def split_rings(t):
    """A square across the seam and one away from it, per event."""
    west = F.when(F.col("event_id") % 2 == 0, 175.0).otherwise(10.0)
    point = lambda lon, lat: F.struct(lon.alias("lon"), F.lit(float(lat)).alias("lat"))
    far = F.when(west > 100, F.lit(-175.0)).otherwise(20.0)
    ring = F.array(point(west, 0), point(far, 0), point(far, 10), point(west, 10), point(west, 0))
    pieces = geo.split_at_seam(ring)
    on_seam = F.exists(F.flatten(pieces), lambda p: F.abs(p.lon) == 180)
    return t["events"].select(
        "event_id", F.size(pieces).alias("pieces"), F.when(on_seam, 180.0).otherwise(0.0).alias("seam")
    )
