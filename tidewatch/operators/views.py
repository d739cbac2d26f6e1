"""Reader queries over events: filters, lenses, boards, briefings, footprints, pages, live projection.

Event columns used: ``id, t, sev, title, summary, src, loc, lat, lon, ts, ingested_at,
n_sources, confidence``. Every clock is the ``as_of_ms`` argument.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import scoring, text, times, urls
from tidewatch.functions import vocabulary as V
from tidewatch.operators.numbering import top_per

LENSES = ("all", "vulnerabilities", "policy", "emerging")
MODES = ("all", "pulse", "news")
RANGES = ("all", *V.RANGE_DAYS)
SORTS = ("newest", "oldest", "severity")


@dataclass(frozen=True)
class FilterSpec:
    """A reader's selection. Build it from untrusted text with :meth:`parse`."""

    topic: str = "all"
    sev: str = "all"
    mode: str = "all"
    range: str = "all"
    src: str = "all"
    lens: str = "all"
    sort: str = "newest"
    q: str = ""
    event: int | None = None

    @classmethod
    def parse(cls, params: dict[str, str]) -> FilterSpec:
        """Unknown values fall back to the default of their field."""
        allowed = {
            "topic": ("all", *V.TOPICS), "sev": ("all", *V.SEVERITIES), "mode": MODES,
            "range": RANGES, "lens": LENSES, "sort": SORTS,
        }
        chosen = {k: params[k] for k, values in allowed.items() if params.get(k) in values}
        event = params.get("event") or ""
        event_id = int(event) if event.isascii() and event.isdigit() else 0
        return replace(
            cls(),
            **chosen,
            src=(params.get("src") or "").strip()[:80] or "all",
            q=(params.get("q") or "")[:200],
            event=event_id if 0 < event_id <= 9_007_199_254_740_991 else None,
        )

    def predicate(self, as_of_ms: int) -> Column:
        c = F.col
        terms = [F.lit(True)]
        if self.topic != "all":
            terms.append(c("t") == self.topic)
        if self.sev != "all":
            terms.append(c("sev") == self.sev)
        if self.src != "all":
            terms.append(c("src") == self.src)
        if self.range != "all":
            terms.append(in_range(self.range, as_of_ms))
        if self.mode != "all":
            hot = scoring.pulse(c("n_sources"), c("confidence"))
            terms.append(hot if self.mode == "pulse" else ~hot)
        if self.lens != "all":
            terms.append(lens(self.lens, as_of_ms))
        if self.q.strip():
            terms.append(text.contains_text(self.q, c("title"), c("summary"), c("loc"), c("src")))
        predicate = terms[0]
        for term in terms[1:]:
            predicate = predicate & term
        return predicate

    def order(self) -> list[Column]:
        c = F.col
        return {
            "newest": [c("ts").desc(), c("id").desc()],
            "oldest": [c("ts").asc(), c("id").asc()],
            "severity": [scoring.severity_rank(c("sev")).asc(), c("ts").desc(), c("id").desc()],
        }[self.sort]


def in_range(name: str, as_of_ms: int) -> Column:
    return times.within(F.col("ts"), as_of_ms, V.RANGE_DAYS[name] * times.DAY_MS)


def lens(name: str, as_of_ms: int) -> Column:
    if name == "vulnerabilities":
        return text.matches_terms(F.col("title"), F.col("summary"), V.VULNERABILITY_LENS)
    if name == "policy":
        return text.matches_terms(F.col("title"), F.col("summary"), V.POLICY_LENS)
    if name == "emerging":
        seen = F.col("ingested_at")
        return F.coalesce((seen > 0) & times.within(seen, as_of_ms, V.EMERGING_MS), F.lit(False))
    return F.lit(True)


def filter_events(events: DataFrame, spec: FilterSpec, as_of_ms: int) -> DataFrame:
    return events.filter(spec.predicate(as_of_ms))


def lens_list(events: DataFrame, name: str, as_of_ms: int) -> DataFrame:
    """Reporting of one lens, without anything dated after ``as_of``; sort with :func:`lens_order`."""
    return events.filter((F.col("ts") <= as_of_ms) & lens(name, as_of_ms))


def lens_order(name: str) -> list[Column]:
    key = "ingested_at" if name == "emerging" else "ts"
    return [F.col(key).desc(), F.col("id").desc()]


def lens_page(events: DataFrame, name: str, as_of_ms: int, size: int = V.INDEX_PAGE) -> DataFrame:
    """The first ``size`` reports of a lens in its order, with their ``place`` from 1. The window sees those rows only."""
    shown = lens_list(events, name, as_of_ms).orderBy(*lens_order(name)).limit(size)
    return shown.withColumn("place", F.row_number().over(Window.orderBy(*lens_order(name))))


def live_events(events: DataFrame, limit: int = V.LIVE_EVENTS) -> DataFrame:
    """The bounded live projection: most recently ingested first."""
    return events.orderBy(F.coalesce("ingested_at", "ts").desc(), F.col("id").desc()).limit(limit)


def newest(events: DataFrame, limit: int) -> DataFrame:
    return events.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(limit)


def page_of(events: DataFrame, page: int, size: int = V.INDEX_PAGE) -> DataFrame:
    """Page ``page`` (from 0) of the newest-first index."""
    return events.orderBy(F.col("ts").desc(), F.col("id").desc()).offset(page * size).limit(size)


def page_after(events: DataFrame, cursor: tuple[int, int] | None, as_of_ms: int, size: int = 100) -> DataFrame:
    """Keyset page: newest first, strictly after ``(ts, id)``, nothing newer than ``as_of``."""
    if not 1 <= size <= 100:
        raise ValueError(f"page size must be 1..100: {size}")
    rows = events.filter(F.col("ts") <= as_of_ms)
    if cursor is not None:
        ts, last_id = cursor
        rows = rows.filter((F.col("ts") < ts) | ((F.col("ts") == ts) & (F.col("id") < last_id)))
    return newest(rows, size)


def with_selected(page: DataFrame, events: DataFrame, event_id: int | None) -> DataFrame:
    """A page with the selected event put in front when the page does not hold it."""
    shown = page.withColumn("front", F.lit(False))
    if event_id is None:
        return shown
    chosen = events.filter(F.col("id") == event_id).select(*page.columns)
    extra = chosen.join(page.select("id"), "id", "left_anti").select(*page.columns)
    return extra.withColumn("front", F.lit(True)).unionByName(shown)


def topic_boards(events: DataFrame, page: int = V.BOARD_PAGE) -> DataFrame:
    """First ``page`` events per topic with the topic's total and how many remain."""
    totals = events.groupBy("t").agg(F.count("*").alias("total"))
    shown = top_per(events.select("t", "id", "title", "ts"), ["t"], page, F.col("ts").desc(), F.col("id").desc())
    # One row per topic on the right.
    return shown.join(totals, "t").withColumn("remaining", F.greatest(F.col("total") - page, F.lit(0)))


def board_counts(events: DataFrame, page: int = V.BOARD_PAGE) -> DataFrame:
    """Every topic with its total and how many remain behind the first ``page``; a topic without events has zeros."""
    totals = events.groupBy("t").agg(F.count("*").alias("total"))
    return _topics(events).join(totals, "t", "left").fillna(0, ["total"]).withColumn("remaining", F.greatest(F.col("total") - page, F.lit(0)))


def _topics(events: DataFrame) -> DataFrame:
    return events.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, V.TOPICS))).alias("t"))


def _window_labels(as_of_ms: int) -> Column:
    """The briefing windows a row falls into; they overlap, so a row can be in several."""
    labels = (F.when(in_range(name, as_of_ms), F.lit(name)) for name in V.RANGE_DAYS)
    return F.array_compact(F.array(*labels))


def briefing_counts(events: DataFrame, as_of_ms: int) -> DataFrame:
    """Reports per window and topic. Counted once per topic, then folded into windows."""
    per_topic = events.groupBy("t").agg(
        *(F.count_if(in_range(name, as_of_ms)).alias(name) for name in V.RANGE_DAYS)
    )
    return per_topic.unpivot("t", list(V.RANGE_DAYS), "period", "reports").filter("reports > 0")


def briefing_totals(events: DataFrame, as_of_ms: int) -> DataFrame:
    """Reports per window in total (t null) and of every topic, zeros included. Topics are counted once, then folded into windows."""
    per_topic = _topics(events).join(events.groupBy("t").agg(*(F.count_if(in_range(name, as_of_ms)).alias(name) for name in V.RANGE_DAYS)), "t", "left")
    folded = per_topic.fillna(0).unpivot("t", list(V.RANGE_DAYS), "period", "reports")
    return folded.groupingSets([["period", "t"], ["period"]], "period", "t").agg(F.sum("reports").alias("reports"))


def briefing_stories(events: DataFrame, as_of_ms: int, top: int = 5) -> DataFrame:
    """The newest reports of each window."""
    rows = events.select("id", "title", "ts", F.explode(_window_labels(as_of_ms)).alias("period"))
    return top_per(rows, ["period"], top, F.col("ts").desc(), F.col("id").desc())


def source_footprint(events: DataFrame, top: int | None = None) -> DataFrame:
    counts = events.groupBy("src").agg(F.count("*").alias("reports"))
    return counts if top is None else counts.orderBy(F.col("reports").desc(), F.col("src")).limit(top)


def source_labels(events: DataFrame, selected: str | None = None) -> DataFrame:
    """Distinct source labels, with a selected label added when no event carries it."""
    labels = events.select("src")
    if selected not in (None, "all"):
        labels = labels.unionByName(events.sparkSession.range(1).select(F.lit(selected).alias("src")))
    return labels.distinct()


def desk_hero(events: DataFrame, size: int = 3) -> DataFrame:
    """Lead story and secondaries: illustrated reports when there are enough, else all.

    Two bounded top-k passes; nothing is ranked over the whole table in one task.
    """
    order = [F.col("ts").desc(), F.col("id").desc()]
    illustrated = F.coalesce(F.col("media_image").rlike(r"(?i)^/?data/media/[a-f0-9]{16}\.jpe?g$"), F.lit(False))
    flagged = events.withColumn("illustrated", illustrated)
    leading = flagged.filter("illustrated").orderBy(*order).limit(size)
    enough = leading.agg((F.count("*") >= size).alias("enough"))
    every = flagged.orderBy(*order).limit(size)
    candidates = leading.withColumn("pool", F.lit(True)).unionByName(every.withColumn("pool", F.lit(False)))
    chosen = candidates.join(enough, F.col("pool") == F.col("enough")).drop("pool", "enough")
    # At most ``size`` rows are ranked here.
    return chosen.withColumn("slot", F.row_number().over(Window.orderBy(*order)))


def reporting_rows(events: DataFrame) -> DataFrame:
    """Index rows: location labelled approximate when it is and does not already say so."""
    tier = F.coalesce("geo_tier", F.lit("approximate"))
    approximate = (tier == "approximate") & ~F.col("loc").rlike("(?i)approximat")
    place = F.when(approximate, F.concat(F.col("loc"), F.lit(" · approximate"))).otherwise(F.col("loc"))
    return events.select("id", "t", "sev", "title", "src", place.alias("place"), "ts")


def primary_source(sources: Column) -> Column:
    return F.get(F.filter(sources, lambda u: u.rlike("(?i)^https?://")), F.lit(0))


def link_list(sources: Column) -> Column:
    """Distinct http(s) links in order, each with its host without a leading ``www.``."""
    links = F.filter(F.array_distinct(sources), lambda u: u.rlike("(?i)^https?://"))
    host = lambda u: F.regexp_replace(F.lower(urls.netloc(u)), r"^www\.|:\d+$", "")
    return F.transform(links, lambda u: F.struct(u.alias("url"), host(u).alias("host")))


def preview_cells(events: DataFrame, limit: int = V.PREVIEW_CELLS) -> DataFrame:
    """Newest event of each 20° cell, newest cells first."""
    cell = F.struct(F.floor(F.col("lon") / 20).alias("x"), F.floor(F.col("lat") / 20).alias("y"))
    order = [F.col("ts").desc(), F.col("id").desc()]
    firsts = top_per(events.withColumn("cell", cell), ["cell"], 1, *order)
    return firsts.orderBy(*order).limit(limit).select("id", "ts", "lat", "lon")


def marker_rank(selected: int | None) -> Column:
    """Drawing priority, higher is drawn later: selected 4, critical 3 … de-escalating 0."""
    rank = 3 - scoring.severity_rank(F.col("sev"))
    return rank if selected is None else F.when(F.col("id") == selected, 4).otherwise(rank)


def manifest_counts(events: DataFrame, **extra: Column | int) -> DataFrame:
    """One row: totals, zero-filled topic and severity counts, PULSE events, caller's extras."""
    return events.agg(
        F.count("*").alias("events"),
        *(F.count_if(F.col("t") == t).alias(f"topic_{t}") for t in V.TOPICS),
        *(F.count_if(F.col("sev") == s).alias(f"severity_{s}") for s in V.SEVERITIES),
        F.count_if(F.col("pulse")).alias("pulse"),
    ).withColumns({k: F.lit(v) if isinstance(v, int) else v for k, v in extra.items()})


def freshness(manifests: DataFrame, as_of_ms: int, disconnected: bool = False, demo: Column | bool = False) -> DataFrame:
    """Status kind, label and age of each manifest at ``as_of``; demonstration data says so before anything else."""
    c, demo = F.col, F.lit(demo) if isinstance(demo, bool) else demo
    minutes = F.greatest(F.lit(0), F.floor((F.lit(as_of_ms) - c("last_sync")) / 60_000))
    age = times.age_label(as_of_ms, c("last_sync"))
    never = F.coalesce(c("last_sync"), F.lit(0)) == 0
    late = never | (minutes >= 30)
    error = c("health") == "error"
    kind = (
        F.when(demo, "demo").when(error, "error").when(F.lit(disconnected) | late | (c("health") == "degraded"), "delayed").otherwise("ok")
    )
    label = (
        F.when(demo, "Demo · fictional events").when(error, "Sources unavailable")
        .when(F.lit(disconnected), "Connection interrupted")
        .when(late, F.concat(F.lit("Data delayed · "), age))
        .when(c("health") == "degraded", "Some sources unavailable")
        .otherwise(F.concat(F.lit("Updated "), age))
    )
    return manifests.withColumns({"kind": kind, "label": label, "age": age})


def layer_status(layers: DataFrame, as_of_ms: int) -> DataFrame:
    """Per layer: unavailable when never loaded, stale when older than five minutes, else current."""
    state = (
        F.when(F.col("loaded_at").isNull(), "unavailable")
        .when(F.lit(as_of_ms) - F.col("loaded_at") > 300_000, "stale")
        .otherwise("current")
    )
    return layers.withColumn("state", state)


def latest_snapshot(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """Newest accepted snapshot per key: highest stamp, a tie goes to the later arrival."""
    stamp = F.coalesce("last_attempt", "last_sync")
    return top_per(snapshots.withColumn("stamp", stamp), keys, 1, F.col("stamp").desc(), F.col("arrival").desc()).drop("rank")
