"""Landed feed documents (RSS 2, RDF, Atom) to items, articles and per-feed status.

Landing layout: ``<root>/feed=<name>/*.xml``; the folder names the feed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import text, times, urls
from tidewatch.functions import vocabulary as V

_TEXT = "array<struct<_VALUE:string,_type:string>>"
_MEDIA = "array<struct<_VALUE:string,_url:string,_type:string,_width:string,_size:string>>"
# ``content``/``thumbnail``/``videoId`` also occur one level down, inside a media group.
_GROUP = f"array<struct<content:{_MEDIA},thumbnail:{_MEDIA},videoId:array<string>>>"
ITEM_SCHEMA = ", ".join(
    (
        f"title {_TEXT}",
        "link array<struct<_VALUE:string,_href:string,_rel:string>>",
        *(f"{name} {_TEXT}" for name in ("pubDate", "date", "updated", "published", "description", "summary")),
        "enclosure array<struct<_VALUE:string,_url:string,_type:string>>",
        f"content {_MEDIA}",
        f"thumbnail {_MEDIA}",
        "videoId array<string>",
        f"group {_GROUP}",
    )
)
XML_OPTIONS = {"ignoreNamespace": "true", "valueTag": "_VALUE", "attributePrefix": "_"}


def feed_registry(spark: SparkSession, feeds=V.FEEDS) -> DataFrame:
    """One row per feed: name, address, topic and registry order."""
    rows = [(i, *feed) for i, feed in enumerate(feeds)]
    return spark.createDataFrame(rows, "feed_order int, feed string, address string, topic string")


def _first_text(*names: str) -> Column:
    firsts = (text.non_empty(text.strip(F.get(F.col(n), F.lit(0))["_VALUE"])) for n in names)
    return F.coalesce(*firsts)


def _link() -> Column:
    """The first link with text, else the last address without a ``rel``."""
    links = F.col("link")
    texts = F.filter(F.transform(links, lambda x: text.strip(x["_VALUE"])), lambda s: s != "")
    plain = F.filter(links, lambda x: (text.strip(x["_href"]) != "") & (F.coalesce(x["_rel"], F.lit("")) == ""))
    return F.coalesce(F.get(texts, F.lit(0)), text.strip(F.try_element_at(plain, F.lit(-1))["_href"]))


def _description() -> Column:
    """Readable lede; encoded bodies are decoded first."""
    first = F.coalesce(F.get(F.col("description"), F.lit(0)), F.get(F.col("summary"), F.lit(0)))
    raw, kind = first["_VALUE"], F.lower(F.coalesce(first["_type"], F.lit("")))
    encoded = kind.contains("base64") & ~raw.contains("<")
    decoded = F.try_to_binary(raw, F.lit("base64"))
    body = F.when(encoded & decoded.isNotNull(), F.decode(decoded, "UTF-8")).otherwise(raw)
    return F.coalesce(text.html_to_text(body, limit=1000), F.lit(""))


def media_score(media: Column, is_thumbnail: bool) -> Column:
    """Preference of one media entry: small declared files, then sensible widths; -1 is never chosen."""
    width = F.coalesce(media["_width"].try_cast("int"), F.lit(0))
    size = media["_size"].try_cast("int")
    has_size = F.coalesce(media["_size"], F.lit("")) != ""
    budget = V.MEDIA_BUDGET_BYTES
    score = F.when(has_size, F.when(size <= 2 * budget, 4 * budget - size).otherwise(-1)).otherwise(
        F.when(width.between(300, 1600), width).otherwise(-1)
    )
    score = F.coalesce(score, F.lit(-1))
    if not is_thumbnail:
        return score
    weak = F.when(width > 0, F.least(width, F.lit(800)) - 200).otherwise(50)
    return F.when(score < 0, weak).otherwise(score)


def _scored(entries: Column, is_thumbnail: bool) -> Column:
    address = lambda m: text.strip(F.coalesce(text.non_empty(m["_url"]), m["_VALUE"], F.lit("")))
    usable = lambda m: (address(m) != "") & (
        F.lit(True) if is_thumbnail else F.lower(F.coalesce(m["_type"], F.lit(""))).contains("image")
    )
    kept = F.filter(F.coalesce(entries, F.array().cast(_MEDIA)), usable)
    return F.transform(
        kept, lambda m, i: F.struct(media_score(m, is_thumbnail).alias("score"), (-i).alias("order"), address(m).alias("url"))
    )


def best_media(content: Column, thumbnail: Column, enclosure: Column) -> Column:
    """Best-scored media image, the first of equals; else the last image enclosure."""
    offered = F.filter(
        F.concat(
            _scored(content, False),
            F.transform(_scored(thumbnail, True), lambda m: F.struct(m.score, (m.order - 1000).alias("order"), m.url)),
        ),
        lambda m: m.score > -1,
    )
    images = F.filter(
        F.coalesce(enclosure, F.array().cast("array<struct<_VALUE:string,_url:string,_type:string>>")),
        lambda e: F.lower(F.coalesce(e["_type"], F.lit(""))).contains("image") & (text.strip(e["_url"]) != ""),
    )
    return F.coalesce(F.array_max(offered).url, text.strip(F.try_element_at(images, F.lit(-1))["_url"]))


def _with_group(name: str) -> Column:
    nested = F.flatten(F.transform(F.coalesce(F.col("group"), F.array().cast(_GROUP)), lambda g: g[name]))
    kind = _MEDIA if name != "videoId" else "array<string>"
    return F.concat(F.coalesce(F.col(name), F.array().cast(kind)), F.coalesce(nested, F.array().cast(kind)))


def project_items(parsed: DataFrame, *carried: str) -> DataFrame:
    """Items from parsed XML records; a record without a usable link is skipped."""
    video = text.strip(F.get(_with_group("videoId"), F.lit(0)))
    return (
        parsed.withColumn("__link", _link())
        .filter(text.non_empty(F.col("__link")).isNotNull())
        .select(
            *carried,
            F.coalesce(_first_text("title"), F.lit("(untitled)")).alias("title"),
            F.col("__link").alias("link"),
            times.parse_pub_date(_first_text("pubDate", "date", "updated", "published")).alias("published_ms"),
            _description().alias("description"),
            F.coalesce(best_media(_with_group("content"), _with_group("thumbnail"), F.col("enclosure")), F.lit("")).alias("media_image"),
            F.when(F.coalesce(video, F.lit("")) != "", F.concat(F.lit("https://www.youtube.com/watch?v="), video))
            .otherwise("").alias("video_url"),
        )
    )


def read_feed_items(spark: SparkSession, landing: str, registry: DataFrame | None = None) -> DataFrame:
    """Items of all landed documents with source, topic and ``seq`` (registry order, file, position)."""
    registry = registry if registry is not None else feed_registry(spark)

    def records(tag: str) -> DataFrame:
        rows = (
            spark.read.format("xml").options(**XML_OPTIONS, rowTag=tag).schema(ITEM_SCHEMA + ", feed string")
            .load(landing)
        )
        return rows.select(
            "*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        )

    parsed = records("item").unionByName(records("entry"))
    items = project_items(parsed, "feed", "path", "block", "row")
    known = items.join(F.broadcast(registry), "feed")  # the registry is a fixed, short list
    # A feed document is at most a few megabytes, so ranking inside one file is bounded.
    placed = known.withColumn(
        "position", F.row_number().over(Window.partitionBy("path").orderBy("block", "row"))
    )
    files = placed.select("feed_order", "path").distinct().withColumn(
        "file", F.row_number().over(Window.orderBy("feed_order", "path"))
    )
    return placed.join(files.select("path", "file"), "path").select(
        (F.col("file").cast("long") * (1 << 20) + F.col("position")).alias("seq"),
        F.col("feed").alias("source"), "topic", "title", "link", "published_ms", "description", "media_image", "video_url",
    )


def items_to_articles(items: DataFrame) -> DataFrame:
    """Feed items in the common article shape. Feeds carry no tone or coordinates."""
    nothing = F.lit(None).cast("string")
    return items.select(
        "seq",
        "title",
        F.col("link").alias("url"),
        F.replace(urls.netloc(F.col("link")), F.lit("www."), F.lit("")).alias("domain"),
        F.lit("English").alias("language"),
        F.lit("0.0").alias("tone"),
        F.when(F.coalesce("published_ms", F.lit(0)) != 0, times.seendate(F.col("published_ms"))).otherwise("").alias("seendate"),
        F.struct(F.lit("").alias("fullName"), F.lit("").alias("countryCode")).alias("location"),
        F.lit("0").alias("lat"),
        F.lit("0").alias("long"),
        F.col("topic").alias("rss_topic"),
        F.col("source").alias("rss_source"),
        F.col("description").alias("rss_description"),
        "media_image",
        "video_url",
        nothing.alias("socialimage"),
    )


def document_status(documents: DataFrame, key: str, body: str) -> DataFrame:
    """Judge each landed document: ``failed`` when it is not XML, empty, or not a feed."""
    parsed = documents.withColumn(
        "__doc", F.from_xml(F.col(body), "channel string, _corrupt_record string",
                            {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"})
    )
    root = F.regexp_extract(F.col(body), r"(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>|\s)*<(?:[\w.-]+:)?([\w.-]+)", 1)
    items = F.regexp_count(F.col(body), F.lit(r"<(?:[\w.-]+:)?(?:item|entry)[\s>]"))
    childless = ~F.col(body).rlike(r"(?s)<[\w:.-]+[^>]*>.*<[\w:.-]+")
    broken = F.col("__doc").isNull() | F.col("__doc._corrupt_record").isNotNull() | childless
    failed = broken | ((items == 0) & ~root.isin("rss", "RDF", "feed"))
    return parsed.select(key, F.when(failed, 0).otherwise(items).alias("items"), failed.alias("failed"))


def source_status(registry: DataFrame, documents: DataFrame) -> DataFrame:
    """Per registered feed: items, failed documents and whether the feed succeeded at all."""
    landed = documents.groupBy("feed").agg(
        F.sum("items").alias("items"), F.count_if("failed").alias("failed_documents"), F.count("*").alias("documents")
    )
    joined = registry.join(landed, "feed", "left").fillna(0, ["items", "failed_documents", "documents"])
    missing = F.col("documents") == F.col("failed_documents")
    return joined.select("feed", "items", "documents", "failed_documents", missing.alias("failed"))


def read_source_status(spark: SparkSession, landing: str, registry: DataFrame | None = None) -> DataFrame:
    bodies = (
        spark.read.format("text").option("wholetext", "true").schema("value string, feed string").load(landing)
    )
    registry = registry if registry is not None else feed_registry(spark)
    return source_status(registry, document_status(bodies, "feed", "value"))
