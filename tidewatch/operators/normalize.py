"""Articles to located, classified, scored events, with a reason for every row that is not one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import geo, scoring, text, times, urls
from tidewatch.functions import vocabulary as V
from tidewatch.functions.places_text import Gazetteer, locate
from tidewatch.functions.staging import materialize
from tidewatch.operators.checks import event_violations

EVENT_COLUMNS = (
    "seq", "t", "sev", "title", "summary", "src", "loc", "lat", "lon", "ts", "ingested_at",
    "url", "tone", "quality", "geo_tier", "geo_source", "geo_policy", "geo_scope", "geo_evidence",
    "media_image", "video_url", "date_defaulted",
)


def normalize(articles: DataFrame, as_of_ms: int, gazetteer: Gazetteer | None = None) -> DataFrame:
    """Judge every article; adds ``outcome`` and, for accepted rows, the event columns.

    ``outcome`` is ``accepted``, ``dropped:<gate>`` or ``rejected:<rule>``. Narrow: no shuffle.
    """
    def number(name: str) -> str:
        # Missing or empty means zero; unreadable voids the pair.
        return f"CASE WHEN coalesce({name}, '') = '' THEN 0.0D ELSE try_cast({name} AS DOUBLE) END"

    unreadable = f"({number('lat')}) IS NULL OR ({number('`long`')}) IS NULL"
    staged = articles.select(
        F.col("title").alias("raw_title"),
        text.strip(F.coalesce("title", F.lit(""))).alias("title"),
        text.strip(F.coalesce("url", F.lit(""))).alias("url"),
        F.substring(text.strip(F.coalesce("rss_description", F.lit(""))), 1, 600).alias("summary"),
        text.strip(F.expr("coalesce(nullif(rss_source, ''), nullif(domain, ''), 'GDELT')")).alias("src0"),
        times.parse_seendate(F.col("seendate")).alias("seen"),
        text.country_label(F.col("location.countryCode")).alias("country"),
        *map(F.expr, (
            "seq", "domain", "language", "media_image", "video_url", "socialimage",
            "nullif(rss_topic, '') AS rss_topic",
            "nullif(location.fullName, '') AS place_name",
            "coalesce(try_cast(tone AS DOUBLE), 0.0D) AS tone",
            f"CASE WHEN {unreadable} THEN 0.0D ELSE {number('lat')} END AS lat0",
            f"CASE WHEN {unreadable} THEN 0.0D ELSE {number('`long`')} END AS lon0",
        )),
    )
    staged = materialize(staged, {"t": F.coalesce(F.col("rss_topic"), text.classify_topic(F.col("title")))})
    gate = """CASE WHEN length(title) < 10 THEN 'dropped:short_title'
                   WHEN NOT (startswith(lower(coalesce(language, '')), 'english') OR lower(language) <=> 'en') THEN 'dropped:language'
                   WHEN t IS NULL THEN 'dropped:topic' END"""
    staged = materialize(
        staged, {"gate": F.expr(gate), "has_position": geo.valid_coordinates(F.col("lat0"), F.col("lon0"))}
    )
    located = locate(
        staged, "title", "summary", "place", when=F.expr("gate IS NULL AND NOT has_position"), gazetteer=gazetteer
    )
    events = located.select(
        "seq", "t", "summary", "url", "media_image", "video_url",
        text.classify_severity(F.col("title"), F.col("tone")).alias("sev"),
        F.when(F.col("src0") == "", urls.outlet_host(F.col("url"))).otherwise(F.col("src0")).alias("src"),
        scoring.quality(F.col("raw_title"), F.col("domain"), F.col("tone"), F.col("socialimage")).alias("quality"),
        *map(F.expr, (
            "substring(title, 1, 200) AS title",
            "substring(CASE WHEN has_position THEN concat_ws(', ', place_name, country) ELSE place.loc END, 1, 80) AS loc",
            "CASE WHEN has_position THEN lat0 ELSE place.lat END AS lat",
            "CASE WHEN has_position THEN lon0 ELSE place.lon END AS lon",
            f"coalesce(nullif(seen, 0), {as_of_ms}L) AS ts",
            f"{as_of_ms}L AS ingested_at",
            "bround(tone, 1) AS tone",
            "CASE WHEN has_position THEN 'precise' ELSE place.tier END AS geo_tier",
            "CASE WHEN has_position THEN 'source' ELSE place.source END AS geo_source",
            "place.policy AS geo_policy", "place.scope AS geo_scope", "place.evidence AS geo_evidence",
            "seen IS NULL AS date_defaulted",
            """CASE WHEN gate IS NOT NULL THEN gate WHEN NOT has_position AND place IS NULL THEN 'dropped:location'
                    WHEN url = '' THEN 'dropped:url' END AS gate""",
        )),
    )
    outcome = F.coalesce("gate", F.concat(F.lit("rejected:"), F.get(event_violations(), F.lit(0))), F.lit("accepted"))
    return materialize(events, {"outcome": outcome}).drop("gate")


def accepted(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("outcome") == "accepted").select(*EVENT_COLUMNS)


def quarantine(judged: DataFrame) -> DataFrame:
    """Rows that became events but break the contract; counted, never published."""
    return judged.filter(F.col("outcome").startswith("rejected:"))


def story_key(df: DataFrame, out: str = "story_key") -> DataFrame:
    """Add the key under which reports of one story meet: topic, ~10 km cell, day, headline."""
    raw = F.concat_ws(
        "|",
        "t",
        F.floor(F.col("lat") * 10 + 0.5).cast("string"),
        F.floor(F.col("lon") * 10 + 0.5).cast("string"),
        times.day_bucket(F.col("ts")).cast("string"),
        text.story_title(F.col("title")),
    )
    return df.withColumn(out, F.sha1(raw))
