"""The driver's parquet tables, and the event-shaped views derived from them.

Each view reads a whole table with simple arithmetic on its key, so it grows with the
table and can be written identically in SQL (see ``tidewatch.catalog.oracle``).
"""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import scoring, text, times
from tidewatch.functions.staging import spread
from tidewatch.operators.normalize import accepted, normalize
from tidewatch.operators.numbering import OrderSpan
from tidewatch.session import configure

# Clock of the article views: the day after their last report.
AS_OF = 1_704_326_400_000
# Clock of the ``events`` views.
EVENTS_AS_OF = 1_706_659_200_000


class Tables:
    """Lazy access to one scale-factor directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = configure(spark), directory.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.directory}/{name}.parquet")
        # Text work is bound by cores, so a table of few row groups is spread over them first.
        return spread(table) if name in ("documents", "pages") else table

    @cached_property
    def doc_span(self) -> OrderSpan:
        """Extent of ``doc_id``; a one-column pass over ``documents``."""
        return OrderSpan.of(self.spark.read.parquet(f"{self.directory}/documents.parquet"), "doc_id")

    def seq_span(self) -> OrderSpan:
        return replace(self.doc_span, column="seq")

    @cached_property
    def articles(self) -> DataFrame:
        """``documents`` as news articles with planted keywords, places and repeats."""
        return self["documents"].selectExpr(
            "doc_id AS seq",
            """CASE doc_id % 5 WHEN 0 THEN 'Ransomware hits grid' WHEN 1 THEN 'Tanker reports piracy'
                 WHEN 2 THEN 'Troops and artillery advance' WHEN 3 THEN 'New tariff announced'
                 ELSE 'Local sports match ends' END
               || CASE doc_id % 7 WHEN 0 THEN ' in Paris' WHEN 1 THEN ' near Kyiv' WHEN 2 THEN ' in the Red Sea'
                 WHEN 3 THEN ' across Germany' WHEN 4 THEN ' to Tokyo' WHEN 5 THEN ' at Lagos' ELSE '' END
               || ', report ' || CAST(doc_id % 10 AS STRING) AS title""",
            "'https://www.' || source || '.example/story/' || CAST(doc_id % 800 AS STRING) AS url",
            "source || '.example' AS domain",
            "CASE lang WHEN 'en' THEN 'English' ELSE lang END AS language",
            "CAST(CAST(doc_id % 31 - 15 AS DOUBLE) AS STRING) AS tone",
            """date_format(timestamp_millis(1704067200000 + doc_id % 3 * 86400000 + doc_id % 24 * 3600000),
                 "yyyyMMdd'T'HHmmss'Z'") AS seendate""",
            "named_struct('fullName', CAST(NULL AS STRING), 'countryCode', 'xx') AS location",
            "CAST(CASE WHEN doc_id % 14 = 0 THEN 0.0D ELSE CAST(doc_id % 70 - 30 AS DOUBLE) END AS STRING) AS lat",
            "CAST(CASE WHEN doc_id % 14 = 0 THEN 0.0D ELSE CAST(doc_id % 70 * 2 - 70 AS DOUBLE) END AS STRING) AS `long`",
            "CAST(NULL AS STRING) AS rss_topic",
            "source AS rss_source",
            "text AS rss_description",
            "CASE WHEN doc_id % 9 = 0 THEN 'https://img.example/' || CAST(doc_id AS STRING) || '.jpg' END AS media_image",
            "CASE WHEN doc_id % 11 = 0 THEN 'https://www.youtube.com/watch?v=video' || CAST(doc_id AS STRING) END AS video_url",
            "CAST(NULL AS STRING) AS socialimage",
        )

    @cached_property
    def judged(self) -> DataFrame:
        return normalize(self.articles, AS_OF)

    @cached_property
    def reports(self) -> DataFrame:
        """Accepted articles as single-source events: id, spread ingest times, confidence, PULSE."""
        events = accepted(self.judged).withColumn("id", F.col("seq") + 1)
        seen = F.col("ts") + F.col("seq") % 97 * times.HOUR_MS
        sources = (F.col("seq") % 4 + 1).cast("int")
        scored = events.withColumns({"ingested_at": seen, "n_sources": sources})
        confidence = scoring.confidence(F.col("quality"), F.col("n_sources"), times.age_hours(AS_OF, F.col("ingested_at")))
        return scored.withColumn("confidence", confidence).withColumn(
            "pulse", scoring.pulse(F.col("n_sources"), F.col("confidence"))
        )

    @cached_property
    def fixes(self) -> DataFrame:
        """``events`` as position reports, one per row, with a stable input position."""
        e = F.col("event_id")
        return self["events"].select(
            e.alias("pos"),
            F.concat(F.lit("ac"), F.col("user_id").cast("string")).alias("id"),
            (e * 37 % 3600 / 10 - 180).alias("lon"),
            (e * 53 % 1700 / 10 - 85).alias("lat"),
            F.floor(F.col("value") * 100).cast("int").alias("alt_m"),
            times.ntz_to_ms(F.col("ts")).alias("clock"),
        )

    @cached_property
    def stream_events(self) -> DataFrame:
        """``events`` as typed records with millisecond times."""
        return self["events"].select(
            F.col("event_id").alias("id"), F.col("event_type").alias("t"), times.ntz_to_ms(F.col("ts")).alias("ts"),
            "user_id", "value", "props",
        )

    @cached_property
    def points(self) -> DataFrame:
        return self.fixes.select(F.col("pos").alias("point_id"), "lon", "lat")

    @cached_property
    def cities(self) -> DataFrame:
        """``customer`` as gazetteer file rows with repeated names."""
        k = F.col("c_custkey")
        return self["customer"].select(
            k.alias("pos"),
            F.concat(F.initcap("c_mktsegment"), F.lit(" "), (k % 40).cast("string")).alias("name"),
            F.col("c_nationkey").cast("string").alias("iso"),
            (k * 997 % 2_000_000).alias("population"),
            (k * 71 % 3600 / 10 - 180).alias("lon"),
            (k * 29 % 1700 / 10 - 85).alias("lat"),
        )

    def polygons(self, table: str, key: str) -> DataFrame:
        """A six-sided ring around a point derived from each row's key."""
        k = F.col(key).cast("long")
        lon, lat = k * 47 % 300 - 150, k * 31 % 120 - 60
        half_width, half_height = (k % 5 + 4).cast("double"), (k % 4 + 3).cast("double")

        def corner(dx: float, dy: float):
            return F.struct(
                (lon + half_width * dx).cast("double").alias("lon"), (lat + half_height * dy).cast("double").alias("lat")
            )

        ring = F.array(corner(-1, 0), corner(-0.5, -1), corner(0.5, -1), corner(1, 0), corner(0.5, 1), corner(-0.5, 1), corner(-1, 0))
        return self[table].select(k.alias("polygon_id"), F.array(ring).alias("rings"))


def document_titles(tables: Tables) -> DataFrame:
    return tables.articles.select("seq", text.strip(F.col("title")).alias("title"))
