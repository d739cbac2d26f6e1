"""Folding a batch of accepted reports into the known events.

Events are kept as two tables: one row per event, and one row per source URL
(``event_sources``). A story that a third of all reports belong to therefore
never becomes one giant row: its members are counted with partial aggregation
and its URLs stay in the long table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import scoring, times, urls
from tidewatch.operators.normalize import story_key
from tidewatch.operators.numbering import OrderSpan, first_per, number


def first_per_url(reports: DataFrame) -> DataFrame:
    """The earliest report of each exact URL."""
    return first_per(reports, ["url"], F.col("seq"))


def unseen_urls(reports: DataFrame, sources: DataFrame) -> DataFrame:
    """Earliest report per URL, without the URLs some event already cites."""
    return first_per_url(reports).join(sources.select("url"), "url", "left_anti")


@dataclass(frozen=True)
class Merge:
    """Result of one fold."""

    new_events: DataFrame  # event columns of newly created events, with ``id``
    new_sources: DataFrame  # id, seq, url: every fresh URL under the event it joined
    fresh: DataFrame  # the reports that survived URL de-duplication, with ``story_key``


def merge_reports(
    reports: DataFrame, events: DataFrame, sources: DataFrame, span: OrderSpan, next_id: int
) -> Merge:
    """Attach fresh reports to the event with their story key, else open new events.

    ``reports`` are accepted event rows with ``seq`` and ``url``; ``events`` are the
    known events with ``id``, ``live_rank`` (their live order) and the key fields;
    ``sources`` lists the URLs of known events. The first report of a new story
    supplies its fields, and ids are dense from ``next_id`` in arrival order.
    """
    known = first_per(story_key(events).select("story_key", "id", "live_rank"), ["story_key"],
                      F.col("live_rank").asc(), F.col("id").desc())
    return attach(story_key(unseen_urls(reports, sources)), known, span, next_id)


def attach(fresh: DataFrame, known: DataFrame, span: OrderSpan, next_id: int) -> Merge:
    """Attach fresh reports (with ``story_key``, one per URL) to the known stories (story_key, id; one row a key), else open new ones."""
    openers = first_per(fresh, ["story_key"], F.col("seq")).join(known, "story_key", "left_anti")
    new_events = number(openers, span, "id", start=next_id)
    owner = known.select("story_key", "id").unionByName(new_events.select("story_key", "id"))
    # The owner side has one row per story, so a hot story is split by AQE on the report side only.
    new_sources = fresh.select("story_key", "seq", "url").join(owner, "story_key").select("id", "seq", "url")
    return Merge(new_events, new_sources, fresh)


def source_totals(sources: DataFrame) -> DataFrame:
    """Per event: distinct sources, http(s) sources and distinct reporting hosts."""
    host = F.when(urls.is_http(F.col("url")), F.lower(urls.outlet_host(F.col("url"))))
    # Partial counts per (event, host) first, so a hot event is reduced map-side and
    # spread over its hosts before anything is keyed by event alone.
    per_host = sources.select("id", host.alias("host")).groupBy("id", "host").agg(F.count("*").alias("n"))
    return per_host.groupBy("id").agg(
        F.sum("n").alias("articles"),
        F.coalesce(F.sum(F.when(F.col("host").isNotNull(), F.col("n"))), F.lit(0)).alias("n_sources"),
        F.count("host").alias("n_outlets"),
    )


def _arrival(sources: DataFrame) -> list[str]:
    """Order of source rows: ``seq`` starts anew in every batch, so the batch (``origin``) comes first where it is known."""
    return [c for c in ("origin", "seq") if c in sources.columns]


def outlets(sources: DataFrame) -> DataFrame:
    """Distinct reporting hosts per event with the place (batch, if known, and ``seq``) of their first appearance."""
    host = F.lower(urls.outlet_host(F.col("url")))
    order = _arrival(sources)
    first = sources.filter(urls.is_http(F.col("url"))).groupBy("id", host.alias("host")).agg(F.min(F.struct(*order)).alias("first"))
    return first.select("id", "host", *(F.col(f"first.{c}").alias(f"first_{c}") for c in order))


def with_scores(events: DataFrame, totals: DataFrame, as_of_ms: int) -> DataFrame:
    """Recompute article count, confidence and PULSE for every event at ``as_of``."""
    return rescored(events.join(totals, "id", "left"), as_of_ms)


def rescored(joined: DataFrame, as_of_ms: int) -> DataFrame:
    """Confidence and PULSE of events that hold their totals, at ``as_of``."""
    # An event without a usable URL still counts as reported by its source label.
    reporting = F.greatest(F.coalesce(F.col("n_outlets"), F.lit(0)), F.lit(1))
    quality = F.when(F.coalesce(F.col("quality"), F.lit(0)) == 0, 40).otherwise(F.col("quality"))
    confidence = scoring.confidence(quality, reporting, times.age_hours(as_of_ms, F.col("ingested_at")))
    return joined.withColumn("confidence", confidence).withColumn(
        "pulse", scoring.pulse(F.col("n_sources"), F.col("confidence"))
    )


def backfill_scores(events: DataFrame, as_of_ms: int) -> DataFrame:
    """Fill confidence and corroboration only where either is missing."""
    missing = F.col("confidence").isNull() | F.col("corroborating").isNull()
    reporting = F.greatest(F.col("n_outlets"), F.lit(1))
    derived = scoring.confidence(F.col("quality"), reporting, times.age_hours(as_of_ms, F.col("ingested_at")))
    return events.withColumns(
        {
            "confidence": F.when(missing, derived).otherwise(F.col("confidence")),
            "corroborating": F.when(missing, F.col("n_sources")).otherwise(F.col("corroborating")),
            "backfilled": missing,
        }
    )


def media_hints(sources: DataFrame, hints: DataFrame, events: DataFrame) -> DataFrame:
    """Image and video per event: what it already has, else the first non-empty hint in order of arrival."""
    matched, order = sources.join(hints, "url"), _arrival(sources)
    image = F.nullif(F.trim("image"), F.lit(""))
    video = F.nullif(F.trim("video_url"), F.lit(""))
    first = matched.groupBy("id").agg(
        F.min(F.when(image.isNotNull(), F.struct(*order, image.alias("value")))).value.alias("hint_image"),
        F.min(F.when(video.isNotNull(), F.struct(*order, video.alias("value")))).value.alias("hint_video"),
    )
    return events.join(first, "id", "left").select(
        "id",
        F.coalesce("image", "hint_image").alias("image"),
        F.coalesce("video_url", "hint_video").alias("video_url"),
    )
