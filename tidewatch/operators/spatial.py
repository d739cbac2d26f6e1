"""Points against polygons and cities through 1° (or coarser) cell keys: equi-joins, never theta joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import geo
from tidewatch.functions import vocabulary as V
from tidewatch.operators.numbering import first_per

CELL_DEG = 1.0


def cell(lon: Column, lat: Column, size: float = CELL_DEG) -> list[Column]:
    return [
        F.floor(lon / F.lit(size)).cast("int").alias("cell_x"),
        F.floor(lat / F.lit(size)).cast("int").alias("cell_y"),
    ]


def _covered_cells(box: Column, size: float) -> tuple[Column, Column]:
    def steps(low: Column, high: Column) -> Column:
        return F.sequence(
            F.floor(low / F.lit(size)).cast("int"), F.floor(high / F.lit(size)).cast("int")
        )

    return steps(box.west, box.east), steps(box.south, box.north)


def polygon_bounds(polygons: DataFrame) -> DataFrame:
    """Box, point-average centroid and circular-mean longitude per polygon, from its rings.

    Rings stay inside their row, so this is a projection.
    """
    points = F.flatten("rings")
    n = F.size(points)

    def mean(value) -> Column:
        return F.aggregate(F.transform(points, value), F.lit(0.0), lambda acc, x: acc + x) / n

    circular = F.degrees(
        F.atan2(mean(lambda p: F.sin(F.radians(p.lon))), mean(lambda p: F.cos(F.radians(p.lon))))
    )
    box = geo.ring_box(points)
    return polygons.withColumns(
        {
            "west": box.west, "south": box.south, "east": box.east, "north": box.north,
            "mean_lon": mean(lambda p: p.lon), "mean_lat": mean(lambda p: p.lat), "circular_lon": circular,
        }
    )


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float = CELL_DEG) -> DataFrame:
    """First polygon (by ``polygon_id``, its file order) with a ring around each point.

    ``points``: unique ``point_id, lon, lat``. Each ring is keyed by the cells its box
    covers, so a point meets only rings near it; the box test precedes the edge walk.
    """
    rings = polygons.select("polygon_id", F.explode("rings").alias("ring"))
    boxed = rings.withColumn("box", geo.ring_box(F.col("ring")))
    xs, ys = _covered_cells(F.col("box"), size)
    celled = boxed.withColumn("cell_x", F.explode(xs)).withColumn("cell_y", F.explode(ys))
    keyed = points.select("point_id", "lon", "lat", *cell(F.col("lon"), F.col("lat"), size))
    box = F.col("box")
    hits = (
        keyed.join(celled, ["cell_x", "cell_y"])
        .filter(F.col("lon").between(box.west, box.east) & F.col("lat").between(box.south, box.north))
        .filter(geo.ring_contains(F.col("ring"), F.col("lon"), F.col("lat")))
    )
    return hits.groupBy("point_id").agg(F.min("polygon_id").alias("polygon_id"))


def nearest_city(
    points: DataFrame, cities: DataFrame, max_deg: float = V.CITY_PICK_DEG, max_km: float = V.CITY_PICK_KM
) -> DataFrame:
    """Nearest city per point within both limits; equal distances keep the earlier city.

    Cities are copied to the 3×3 cells around them (a fixed factor on the small,
    de-duplicated gazetteer), so points are keyed once and never copied.
    """
    size = max_deg
    near = F.sequence(F.lit(-1), F.lit(1))
    spread = (
        cities.select("city_id", F.col("lon").alias("city_lon"), F.col("lat").alias("city_lat"),
                      *cell(F.col("lon"), F.col("lat"), size))
        .withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near))
        .withColumn("cell_x", F.col("cell_x") + F.col("dx"))
        .withColumn("cell_y", F.col("cell_y") + F.col("dy"))
        .drop("dx", "dy")
    )
    keyed = points.select("point_id", "lon", "lat", *cell(F.col("lon"), F.col("lat"), size))
    dx, dy = F.col("city_lon") - F.col("lon"), F.col("city_lat") - F.col("lat")
    km = geo.haversine_km(F.col("lon"), F.col("lat"), F.col("city_lon"), F.col("city_lat"))
    close = (
        keyed.join(spread, ["cell_x", "cell_y"])
        .filter(dx * dx + dy * dy <= max_deg * max_deg)
        .withColumn("km", km)
        .filter(F.col("km") < max_km)
    )
    return close.groupBy("point_id").agg(F.min(F.struct("km", "city_id")).alias("best")).select(
        "point_id", F.col("best.city_id").alias("city_id"), F.col("best.km").alias("km")
    )


def count_within(points: DataFrame, centers: DataFrame, radius_km: float = V.CITY_RING_KM) -> DataFrame:
    """Points within ``radius_km`` of each center (``center_id, lon, lat``), zero included.

    Cells are a radius high; toward the poles a center covers more columns, as many
    as its latitude needs, and the seam is crossed by wrapping the column number.
    """
    size = radius_km / 111.0
    columns = math.ceil(360.0 / size)
    size_x = 360.0 / columns

    def column(lon: Column) -> Column:
        return F.floor((lon + 180) / F.lit(size_x)).cast("int")

    def row(lat: Column) -> Column:
        return F.floor((lat + 90) / F.lit(size)).cast("int")

    # Longitude half-width of the circle, from the latitude of its pole-side edge.
    edge = F.least(F.abs(F.col("lat")) + size * 1.01, F.lit(89.9))
    half = F.when(
        F.abs(F.col("lat")) + size * 1.01 >= 89.9, F.lit(180.0)
    ).otherwise(F.least(F.lit(size * 1.01) / F.cos(F.radians(edge)), F.lit(180.0)))
    low, high = column(F.col("lon") - half), column(F.col("lon") + half)
    spread = (
        centers.select("center_id", F.col("lon").alias("center_lon"), F.col("lat").alias("center_lat"),
                       low.alias("low"), high.alias("high"), row(F.col("lat")).alias("row"))
        .withColumn("cell_x", F.explode(F.array_distinct(
            F.transform(F.sequence("low", "high"), lambda x: F.pmod(x, F.lit(columns))))))
        .withColumn("cell_y", F.explode(F.sequence(F.col("row") - 2, F.col("row") + 2)))
    )
    keyed = points.select(
        F.col("lon"), F.col("lat"),
        F.pmod(column(F.col("lon")), F.lit(columns)).alias("cell_x"), row(F.col("lat")).alias("cell_y"),
    )
    km = geo.haversine_km(F.col("lon"), F.col("lat"), F.col("center_lon"), F.col("center_lat"))
    counts = (
        keyed.join(spread, ["cell_x", "cell_y"]).filter(km < radius_km)
        .groupBy("center_id").agg(F.count("*").alias("n"))
    )
    return centers.select("center_id").join(counts, "center_id", "left").select(
        "center_id", F.coalesce("n", F.lit(0)).alias("n")
    )


def region_box(polygons: DataFrame) -> DataFrame:
    """Export box per polygon, longitudes unwrapped around its circular-mean centre."""
    centered = polygon_bounds(polygons)
    points = F.flatten("rings")
    lons = F.transform(points, lambda p: geo.unwrap_around(p.lon, F.col("circular_lon")))
    lats = F.transform(points, lambda p: p.lat)
    return centered.select(
        "polygon_id",
        geo.wrap_degrees(F.array_min(lons)).alias("west"),
        geo.wrap_degrees(F.array_max(lons)).alias("east"),
        F.array_min(lats).alias("south"),
        F.array_max(lats).alias("north"),
    )


def gazetteer(rows: DataFrame, min_population: int = V.MIN_CITY_POPULATION) -> DataFrame:
    """Cities of enough population, first row per (iso, lower-cased name) in file order ``pos``."""
    usable = rows.filter(
        F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")
        & (F.coalesce("population", F.lit(0)) >= min_population)
    )
    keyed = usable.withColumn("key", F.lower("name"))
    return first_per(keyed, ["iso", "key"], F.col("pos")).select(
        "pos", "name", "iso", "population", F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat")
    )


def city_detail(cities: DataFrame, height_m: float, limit: int = 12_000) -> DataFrame:
    """Cities drawn at a camera height; ``index`` is their dense 0-based file position."""
    if height_m > 1.7e7:
        shown = cities.filter(F.lit(False))
    elif height_m < 3e6:
        shown = cities
    elif height_m < 9e6:
        shown = cities.filter(F.col("population") >= 250_000)
    else:
        sampled = (F.col("index") % 4 == 0) & (F.col("population") >= 120_000)
        shown = cities.filter((F.col("population") >= 750_000) | sampled)
        limit = 600
    return shown.orderBy("index").limit(limit)
