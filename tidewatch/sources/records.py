"""JSON landings: article lists, state vectors, host searches, regions, seismic and map files.

Every reader has an explicit schema; nothing is inferred from data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import times
from tidewatch.functions import vocabulary as V
from tidewatch.functions.staging import materialize
from tidewatch.operators.tracks import TRAIL, state_columns

ARTICLE = (
    "title string, url string, domain string, language string, tone string, seendate string, socialimage string, "
    "location struct<fullName:string,countryCode:string>, lat string, `long` string"
)
TIMESPANS = {"15min": 15 * 60_000, "24h": 24 * 3_600_000}


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("text").option("wholetext", "true").schema("value string").load(path)


# -- article lists ---------------------------------------------------------------------------


def article_rows(documents: DataFrame, body: str, *carried: str) -> DataFrame:
    """Articles of ``{"articles": [...]}`` bodies in document order."""
    parsed = documents.select(*carried, F.from_json(F.col(body), f"articles array<struct<{_fields(ARTICLE)}>>").alias("doc"))
    return parsed.select(*carried, F.posexplode("doc.articles").alias("pos", "a")).select(*carried, "pos", "a.*")


def _fields(ddl: str) -> str:
    """Column list as struct fields."""
    return ddl.replace(" string", ":string").replace("location struct", "location:struct")


def latest_articles(articles: DataFrame, as_of_ms: int, timespan: str = "15min", limit: int = V.ARTICLES_PER_CALL) -> DataFrame:
    """The newest articles of the trailing window; ``limit`` is the size of one call (at most 250)."""
    seen = times.parse_seendate(F.col("seendate"))
    recent = articles.filter(times.within(seen, as_of_ms, TIMESPANS[timespan]))
    return recent.orderBy(seen.desc(), F.col("url").asc()).limit(min(limit, V.ARTICLES_PER_CALL))


def as_batch(articles: DataFrame, seq: Column) -> DataFrame:
    """Provider articles in the common article shape (no feed hints)."""
    nothing = F.lit(None).cast("string")
    return articles.select(
        seq.cast("long").alias("seq"), "title", "url", "domain", "language", "tone", "seendate", "location", "lat", "long",
        nothing.alias("rss_topic"), nothing.alias("rss_source"), nothing.alias("rss_description"),
        nothing.alias("media_image"), nothing.alias("video_url"), "socialimage",
    )


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    rows = article_rows(_documents(spark, path).withColumn("path", F.col("_metadata.file_path")), "value", "path")
    return as_batch(rows, F.monotonically_increasing_id())


def union_batches(feed_articles: DataFrame, other_articles: DataFrame) -> DataFrame:
    """Feed articles first, then the other provider's; ``seq`` keeps that order."""
    first = feed_articles.withColumn("seq", F.col("seq") * 2)
    second = other_articles.withColumn("seq", F.col("seq") * 2 + 1)
    return first.withColumn("batch", F.lit(0)).unionByName(second.withColumn("batch", F.lit(1)))


def with_provider(articles: DataFrame, use_second: bool) -> DataFrame:
    """Stamp each article's provider from its feed marker.

    When nothing is marked the whole batch belongs to the feeds; unmarked rows of a
    marked batch belong to the second provider, or to nobody when it is off.
    """
    marked = F.coalesce(F.col("rss_source"), F.lit("")) != ""
    flags = articles.agg(F.max(marked).alias("any_marked"))
    provider = (
        F.when(marked | ~F.coalesce("any_marked", F.lit(False)), "rss").when(F.lit(use_second), "gdelt")
    )
    # One row on the right, from an ungrouped aggregate.
    return (
        articles.withColumn("one", F.lit(1)).join(F.broadcast(flags.withColumn("one", F.lit(1))), "one")
        .withColumn("provider", provider).drop("one", "any_marked")
    )


# -- state vectors ---------------------------------------------------------------------------


def state_rows(documents: DataFrame, body: str, *carried: str) -> DataFrame:
    """State vectors of ``{"time": s, "states": [[...]]}`` bodies with their batch clock in ms."""
    schema = "time bigint, states array<array<string>>"
    parsed = materialize(documents.select(*carried, body), {"doc": F.from_json(F.col(body), schema)})
    rows = parsed.select(*carried, F.col("doc.time").alias("time"), F.posexplode("doc.states").alias("pos", "vector"))
    return rows.select(
        *carried, "pos", (F.col("time") * 1000).alias("clock"), F.size("vector").alias("n_fields"), *state_columns(F.col("vector"))
    )


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return state_rows(_documents(spark, path), "value")


def read_previous_trails(spark: SparkSession, path: str) -> DataFrame:
    """Trails of the last published envelope; an absent or unusable file is an empty table."""
    empty = spark.createDataFrame([], f"id string, trail {TRAIL}")
    try:
        bodies = _documents(spark, path)
    except Exception as error:  # the path does not exist yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return empty
    schema = "aircraft array<struct<id:string>>, trails map<string,array<array<double>>>"
    parsed = bodies.select(F.from_json("value", schema).alias("doc")).filter("doc.aircraft IS NOT NULL")
    points = F.transform(
        F.filter("points", lambda p: F.size(p) == 3),
        lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"), p[2].cast("long").alias("ts")),
    )
    return parsed.select(F.explode("doc.trails").alias("id", "points")).select("id", points.alias("trail"))


# -- hosts and regions -----------------------------------------------------------------------

_HOST = (
    "struct<ip:string,services:array<struct<port:int>>,location:struct<country_code:string,"
    "coordinates:struct<latitude:double,longitude:double>>>"
)


def host_rows(documents: DataFrame, body: str, *carried: str) -> DataFrame:
    """Hosts of search results; null hits are an empty result."""
    schema = f"result struct<total_hits:bigint,hits:array<struct<host_v1:struct<resource:{_HOST}>>>>"
    parsed = documents.select(*carried, F.from_json(F.col(body), schema).alias("doc"))
    rows = parsed.select(*carried, F.posexplode("doc.result.hits").alias("host_pos", "hit"))
    host = F.col("hit.host_v1.resource")
    return rows.select(
        *carried, "host_pos", host.ip.alias("ip"),
        host.location.coordinates.latitude.alias("latitude"),
        host.location.coordinates.longitude.alias("longitude"),
        host.location.country_code.alias("country_code"),
        F.transform(host.services, lambda s: s.port).alias("ports"),
    )


REGION = "kind string, name string, country_code string, west double, east double, south double, north double"


def region_rows(documents: DataFrame, body: str, *carried: str) -> DataFrame:
    """Regions of a bare array or of ``{"regions": [...]}``, in order."""
    element = "array<struct<" + REGION.replace(" string", ":string").replace(" double", ":double") + ">>"
    array = F.from_json(F.when(F.trim(body).startswith("["), F.col(body)), element)
    wrapped = F.from_json(F.when(F.trim(body).startswith("{"), F.get_json_object(body, "$.regions")), element)
    return documents.select(*carried, F.posexplode(F.coalesce(array, wrapped)).alias("region_pos", "r")).select(
        *carried, "region_pos", "r.*"
    )


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    return region_rows(_documents(spark, path), "value")


# -- seismic and map files -------------------------------------------------------------------

_FEATURES = (
    "features array<struct<geometry:struct<coordinates:array<double>>,properties:struct<mag:double,place:string>>>"
)


def seismic_points(documents: DataFrame, body: str, *carried: str) -> DataFrame:
    """Located features above the magnitude floor among the first 260 of each collection."""
    parsed = documents.select(*carried, F.from_json(F.col(body), _FEATURES).alias("doc"))
    rows = parsed.select(*carried, F.posexplode(F.slice("doc.features", 1, V.SEISMIC_FEATURES)).alias("pos", "f"))
    points = rows.select(
        *carried, "pos", F.get("f.geometry.coordinates", F.lit(0)).alias("lon"),
        F.get("f.geometry.coordinates", F.lit(1)).alias("lat"),
        F.coalesce("f.properties.mag", F.lit(0.0)).alias("mag"), F.col("f.properties.place").alias("place"),
    )
    located = F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~F.isnan(F.col("lon") + F.col("lat"))
    return points.filter(located & ~F.isnan("mag") & (F.col("mag") > V.SEISMIC_MIN_MAG))


def polygon_rows(documents: DataFrame, body: str) -> DataFrame:
    """Country polygons in file order (``polygon_id``), features without rings skipped."""
    schema = "features array<struct<properties:struct<name:string,iso:string>,rings:array<array<array<double>>>>>"
    rows = documents.select(F.posexplode(F.from_json(F.col(body), schema).features).alias("polygon_id", "f"))
    point = lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))
    rings = F.transform("f.rings", lambda ring: F.transform(ring, point))
    return rows.filter(F.size("f.rings") > 0).select(
        "polygon_id", F.col("f.properties.name").alias("name"), F.upper("f.properties.iso").alias("iso3"), rings.alias("rings")
    )


def city_rows(documents: DataFrame, body: str) -> DataFrame:
    """``[lat, lon, name, iso, population]`` rows in file order."""
    rows = documents.select(F.posexplode(F.from_json(F.col(body), "array<array<string>>")).alias("pos", "r"))
    at = lambda i: F.get("r", F.lit(i))
    return rows.select(
        "pos", at(0).try_cast("double").alias("lat"), at(1).try_cast("double").alias("lon"),
        at(2).alias("name"), at(3).alias("iso"), at(4).try_cast("double").cast("long").alias("population"),
    )


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    return polygon_rows(_documents(spark, path), "value")


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    return city_rows(_documents(spark, path), "value")
