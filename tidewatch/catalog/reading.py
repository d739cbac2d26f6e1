"""Queries: what readers ask of the event table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatch.catalog import oracle as O
from tidewatch.catalog.registry import query
from tidewatch.functions import text, times
from tidewatch.functions import vocabulary as V
from tidewatch.operators import checks, views
from tidewatch.session import shared_folder
from tidewatch.sources.snapshots import Place, read_snapshot
from tidewatch.sources.tables import AS_OF, EVENTS_AS_OF

_24H = f"ts BETWEEN {AS_OF} - {O.DAY} AND {AS_OF}"


@query(
    "filter_events",
    f"""SELECT id, title, ts FROM reports WHERE t = 'cyber' AND pulse AND {_24H}
          AND contains(lower(title || ' ' || summary || ' ' || loc || ' ' || src), 'grid in') """,
    ctes=O.REPORT_CTES,
)
def filter_events(t):
    spec = views.FilterSpec.parse({"topic": "cyber", "mode": "pulse", "range": "24h", "q": " Grid IN", "sev": "bogus"})
    return views.filter_events(t.reports, spec, AS_OF).select("id", "title", "ts")


@query(
    "filter_news_by_source",
    "SELECT id, confidence FROM reports WHERE NOT pulse AND src = 'src4' AND sev = 'watching'",
    ctes=O.REPORT_CTES,
)
def filter_news_by_source(t):
    spec = views.FilterSpec(mode="news", src="src4", sev="watching")
    return views.filter_events(t.reports, spec, AS_OF).select("id", "confidence")


@query("range_filter", f"SELECT id, ts FROM reports WHERE {_24H}", ctes=O.REPORT_CTES)
def range_filter(t):
    return t.reports.filter(views.in_range("24h", AS_OF)).select("id", "ts")


_LENS = """
lens_reports AS (
  SELECT id, ts, ingested_at, title, summary || CASE seq % 5
    WHEN 0 THEN ' See CVE-2024-12345.' WHEN 1 THEN ' A zero day was exploited.' WHEN 2 THEN ' New regulation and compliance.'
    WHEN 3 THEN ' The privacy law passed.' ELSE '' END AS summary
  FROM reports)
"""


def _lens_reports(t):
    s = F.col("seq") % 5
    note = (
        F.when(s == 0, " See CVE-2024-12345.").when(s == 1, " A zero day was exploited.")
        .when(s == 2, " New regulation and compliance.").when(s == 3, " The privacy law passed.").otherwise("")
    )
    return t.reports.withColumn("summary", F.concat("summary", note))


def _lens_query(name: str, condition: str):
    key = "ingested_at" if name == "emerging" else "ts"

    @query(
        f"lens_page_{name}",
        f"""SELECT id, row_number() OVER (ORDER BY {key} DESC, id DESC) AS place FROM lens_reports WHERE ts <= {AS_OF} AND {condition}
            QUALIFY row_number() OVER (ORDER BY {key} DESC, id DESC) <= 50""",
        ctes=(*O.REPORT_CTES, _LENS),
    )
    def page(t):
        return views.lens_page(_lens_reports(t), name, AS_OF).select("id", "place")

    @query(
        f"lens_{name}",
        f"SELECT id, ts FROM lens_reports WHERE ts <= {AS_OF} AND {condition}",
        ctes=(*O.REPORT_CTES, _LENS),
    )
    def lens(t):
        return views.lens_list(_lens_reports(t), name, AS_OF).select("id", "ts")

    return lens


_lens_query("vulnerabilities", f"regexp_matches(title || ' ' || summary, '{V.VULNERABILITY_LENS}', 'i')")
_lens_query("policy", f"regexp_matches(title || ' ' || summary, '{V.POLICY_LENS}', 'i')")
_lens_query("emerging", f"ingested_at BETWEEN {AS_OF} - 172800000 AND {AS_OF}")


@query(
    "sort_modes",
    """SELECT * FROM (SELECT 'newest' AS mode, id FROM reports ORDER BY ts DESC, id DESC LIMIT 50)
       UNION ALL SELECT * FROM (SELECT 'oldest' AS mode, id FROM reports ORDER BY ts, id LIMIT 50)
       UNION ALL SELECT * FROM (SELECT 'severity' AS mode, id FROM reports
         ORDER BY CASE sev WHEN 'critical' THEN 0 WHEN 'escalating' THEN 1 WHEN 'watching' THEN 2 ELSE 3 END, ts DESC, id DESC LIMIT 50)""",
    ctes=O.REPORT_CTES,
)
def sort_modes(t):
    pages = [
        t.reports.orderBy(*views.FilterSpec(sort=mode).order()).limit(V.INDEX_PAGE).select(F.lit(mode).alias("mode"), "id")
        for mode in views.SORTS
    ]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


@query(
    "live_top500",
    "SELECT id, title, ingested_at FROM reports ORDER BY ingested_at DESC, id DESC LIMIT 500",
    ctes=O.REPORT_CTES,
)
def live_top500(t):
    return views.live_events(t.reports).select("id", "title", "ingested_at")


@query("overview_top12", "SELECT id, ts FROM reports ORDER BY ts DESC, id DESC LIMIT 12", ctes=O.REPORT_CTES)
def overview_top12(t):
    return views.newest(t.reports, V.OVERVIEW_ROWS).select("id", "ts")


@query("page_rows", "SELECT id, ts FROM reports ORDER BY ts DESC, id DESC LIMIT 50 OFFSET 100", ctes=O.REPORT_CTES)
def page_rows(t):
    return views.page_of(t.reports, 2).select("id", "ts")


@query(
    "keyset_page",
    f"""SELECT id, ts FROM stream WHERE ts <= {EVENTS_AS_OF} AND (ts < 1705305600000 OR (ts = 1705305600000 AND id < 5000))
        ORDER BY ts DESC, id DESC LIMIT 100""",
    ctes=(O.STREAM,),
)
def keyset_page(t):
    return views.page_after(t.stream_events, (1_705_305_600_000, 5000), EVENTS_AS_OF).select("id", "ts")


@query(
    "with_selected",
    """SELECT id, front FROM (SELECT id, false AS front FROM reports ORDER BY ts DESC, id DESC LIMIT 12)
       UNION ALL SELECT id, true FROM reports WHERE id = (SELECT min(id) FROM reports)
         AND id NOT IN (SELECT id FROM reports ORDER BY ts DESC, id DESC LIMIT 12)""",
    ctes=O.REPORT_CTES,
)
def with_selected(t):
    first = t.reports.agg(F.min("id")).first()[0]
    page = views.newest(t.reports, V.OVERVIEW_ROWS).select("id", "title")
    return views.with_selected(page, t.reports, first).select("id", "front")


@query(
    "topic_boards",
    """SELECT t, id, rank, total, greatest(total - 3, 0) AS remaining FROM (
         SELECT t, id, row_number() OVER (PARTITION BY t ORDER BY ts DESC, id DESC) AS rank, count(*) OVER (PARTITION BY t) AS total
         FROM reports) WHERE rank <= 3""",
    ctes=O.REPORT_CTES,
)
def topic_boards(t):
    return views.topic_boards(t.reports).select("t", "id", "rank", "total", "remaining")


_PERIODS = " UNION ALL ".join(
    f"SELECT '{name}' AS period, id, t, ts, value FROM stream WHERE ts BETWEEN {EVENTS_AS_OF} - {days * O.DAY} AND {EVENTS_AS_OF}"
    for name, days in V.RANGE_DAYS.items()
)


@query(
    "briefing_windows",
    f"SELECT period, t, count(*) AS reports FROM ({_PERIODS}) GROUP BY ALL",
    ctes=(O.STREAM,),
)
def briefing_windows(t):
    return views.briefing_counts(t.stream_events, EVENTS_AS_OF)


@query(
    "briefing_totals",
    f"""SELECT period, t, CAST(sum(n) AS BIGINT) AS reports FROM (
          SELECT p.period, q.t, count(x.id) AS n FROM (SELECT unnest({list(V.RANGE_DAYS)}) AS period) p CROSS JOIN (SELECT unnest({list(V.TOPICS)}) AS t) q
          LEFT JOIN ({_PERIODS}) x ON x.period = p.period AND x.t = q.t GROUP BY p.period, q.t)
        GROUP BY GROUPING SETS ((period, t), (period))""",
    ctes=(O.STREAM, ),
)
def briefing_totals(t):
    """Events of the stream under topics of which some never occur."""
    return views.briefing_totals(t.stream_events, EVENTS_AS_OF)


@query(
    "board_counts",
    f"""SELECT q.t, count(r.id) AS total, greatest(count(r.id) - 3, 0) AS remaining FROM (SELECT unnest({list(V.TOPICS)}) AS t) q
        LEFT JOIN (SELECT * FROM reports WHERE t <> 'maritime') r ON r.t = q.t GROUP BY q.t""",
    ctes=O.REPORT_CTES,
)
def board_counts(t):
    """Boards of a selection that leaves one topic empty."""
    return views.board_counts(t.reports.filter("t <> 'maritime'"))


@query(
    "briefing_stories",
    f"""SELECT period, id, rank FROM (SELECT period, id, row_number() OVER (PARTITION BY period ORDER BY ts DESC, id DESC) AS rank
        FROM ({_PERIODS})) WHERE rank <= 5""",
    ctes=(O.STREAM,),
)
def briefing_stories(t):
    events = t.stream_events.withColumn("title", F.col("t"))
    return views.briefing_stories(events, EVENTS_AS_OF).select("period", "id", "rank")


@query(
    "source_footprint",
    "SELECT src, count(*) AS reports FROM reports GROUP BY src ORDER BY reports DESC, src LIMIT 16",
    ctes=O.REPORT_CTES,
)
def source_footprint(t):
    return views.source_footprint(t.reports, V.FOOTPRINT_ROWS)


@query("source_labels", "SELECT DISTINCT src FROM reports UNION SELECT 'Unlisted'", ctes=O.REPORT_CTES)
def source_labels(t):
    return views.source_labels(t.reports, "Unlisted")


@query(
    "desk_hero",
    """SELECT id, slot FROM (SELECT id, row_number() OVER (ORDER BY ts DESC, id DESC) AS slot FROM reports WHERE seq % 13 = 1)
       WHERE slot <= 3""",
    ctes=O.REPORT_CTES,
)
def desk_hero(t):
    image = F.when(F.col("seq") % 13 == 1, F.concat(F.lit("data/media/"), F.substring(F.md5(F.col("seq").cast("string")), 1, 16), F.lit(".jpg")))
    return views.desk_hero(t.reports.withColumn("media_image", image)).select("id", "slot")


@query(
    "reporting_rows",
    """SELECT id, CASE WHEN geo_tier = 'approximate' AND NOT regexp_matches(loc, 'approximat', 'i') THEN loc || ' · approximate' ELSE loc END AS place
       FROM (SELECT id, loc, CASE WHEN seq % 3 = 0 THEN 'approximate' ELSE geo_tier END AS geo_tier FROM reports)""",
    ctes=O.REPORT_CTES,
)
def reporting_rows(t):
    tier = F.when(F.col("seq") % 3 == 0, "approximate").otherwise(F.col("geo_tier"))
    return views.reporting_rows(t.reports.withColumn("geo_tier", tier)).select("id", "place")


@query(
    "source_links",
    """SELECT page_id, url AS primary_url, CAST(2 AS INTEGER) AS links,
         regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') AS first_host FROM pages""",
)
def source_links(t):
    sources = F.array(F.lit("ftp://x.example/a"), F.col("url"), F.col("url"), F.concat("url", F.lit("&again=1")))
    links = views.link_list(sources)
    return t["pages"].select(
        "page_id", views.primary_source(sources).alias("primary_url"), F.size(links).alias("links"),
        F.get(links, F.lit(0)).host.alias("first_host"),
    )


_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(
    "clip_text",
    f"""SELECT doc_id, CASE WHEN length({_FLAT}) > 104 THEN rtrim(substr({_FLAT}, 1, 101)) || '…' ELSE {_FLAT} END AS clip
        FROM documents""",
)
def clip_text(t):
    return t["documents"].select("doc_id", text.clip(F.col("text")).alias("clip"))


@query(
    "preview_cells",
    """SELECT id, ts FROM (SELECT id, ts, row_number() OVER (
           PARTITION BY floor(lon / 20), floor(lat / 20) ORDER BY ts DESC, id DESC) AS rn FROM reports)
       WHERE rn = 1 ORDER BY ts DESC, id DESC LIMIT 14""",
    ctes=O.REPORT_CTES,
)
def preview_cells(t):
    return views.preview_cells(t.reports).select("id", "ts")


@query(
    "marker_priority",
    """SELECT id, CASE WHEN id = 2 THEN 4 ELSE CASE sev WHEN 'critical' THEN 3 WHEN 'escalating' THEN 2 WHEN 'watching' THEN 1 ELSE 0 END END AS priority
       FROM reports""",
    ctes=O.REPORT_CTES,
)
def marker_priority(t):
    return t.reports.select("id", views.marker_rank(2).alias("priority"))


@query(
    "latest_snapshot",
    """SELECT user_id, id AS arrival, stamp FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY stamp DESC, id DESC) AS rn FROM (
           SELECT user_id, id, CASE WHEN id % 3 = 0 THEN ts // 3600000 ELSE ts // 3600000 + 2 END AS stamp FROM stream)) WHERE rn = 1""",
    ctes=(O.STREAM,),
)
def latest_snapshot(t):
    hour = F.floor(F.col("ts") / times.HOUR_MS)
    snapshots = t.stream_events.select(
        "user_id", F.col("id").alias("arrival"), F.when(F.col("id") % 3 != 0, hour + 2).alias("last_attempt"), hour.alias("last_sync")
    )
    return views.latest_snapshot(snapshots, ["user_id"]).select("user_id", "arrival", "stamp")


@query(
    "freshness",
    f"""SELECT id, CASE WHEN id % 7 = 0 THEN 'error' WHEN id % 11 = 0 OR mins >= 30 OR id % 5 = 0 THEN 'delayed' ELSE 'ok' END AS kind,
          CASE WHEN mins < 1 THEN 'just now' WHEN mins < 60 THEN CAST(mins AS VARCHAR) || 'm ago'
               WHEN mins < 1440 THEN CAST(mins // 60 AS VARCHAR) || 'h ago' ELSE CAST(mins // 1440 AS VARCHAR) || 'd ago' END AS age
        FROM (SELECT id, greatest(0, CAST(floor(({EVENTS_AS_OF} - CASE WHEN id % 11 = 0 THEN 0 ELSE sync END) / 60000.0) AS BIGINT)) AS mins FROM (
          SELECT id, CASE WHEN id % 2 = 0 THEN {EVENTS_AS_OF} - ts % 3600000 ELSE ts END AS sync FROM stream))""",
    ctes=(O.STREAM,),
)
def freshness(t):
    return views.freshness(_manifests(t), EVENTS_AS_OF).select("id", "kind", "age")


def _manifests(t):
    i, ts = F.col("id"), F.col("ts")
    sync = F.when(i % 2 == 0, F.lit(EVENTS_AS_OF) - ts % 3_600_000).otherwise(ts)
    return t.stream_events.select(
        "id", F.when(i % 11 == 0, 0).otherwise(sync).alias("last_sync"),
        F.when(i % 7 == 0, "error").when(i % 5 == 0, "degraded").otherwise("ok").alias("health"),
    )


@query(
    "freshness_labels",
    f"""SELECT id, CASE WHEN id % 13 = 0 THEN 'demo' WHEN id % 7 = 0 THEN 'error' WHEN id % 11 = 0 OR mins >= 30 OR id % 5 = 0 THEN 'delayed' ELSE 'ok' END AS kind,
          CASE WHEN id % 13 = 0 THEN 'Demo · fictional events' WHEN id % 7 = 0 THEN 'Sources unavailable' WHEN id % 11 = 0 OR mins >= 30 THEN 'Data delayed · ' || age
               WHEN id % 5 = 0 THEN 'Some sources unavailable' ELSE 'Updated ' || age END AS label
        FROM (SELECT id, mins, CASE WHEN mins < 1 THEN 'just now' WHEN mins < 60 THEN CAST(mins AS VARCHAR) || 'm ago'
               WHEN mins < 1440 THEN CAST(mins // 60 AS VARCHAR) || 'h ago' ELSE CAST(mins // 1440 AS VARCHAR) || 'd ago' END AS age
          FROM (SELECT id, greatest(0, CAST(floor(({EVENTS_AS_OF} - CASE WHEN id % 11 = 0 THEN 0 ELSE sync END) / 60000.0) AS BIGINT)) AS mins FROM (
            SELECT id, CASE WHEN id % 2 = 0 THEN {EVENTS_AS_OF} - ts % 3600000 ELSE ts END AS sync FROM stream)))""",
    ctes=(O.STREAM,),
)
def freshness_labels(t):
    return views.freshness(_manifests(t), EVENTS_AS_OF, demo=F.col("id") % 13 == 0).select("id", "kind", "label")


@query(
    "layer_status",
    f"""SELECT t AS layer, n AS rows, CASE WHEN t = 'view' THEN 'unavailable' WHEN {EVENTS_AS_OF} - last > 300000 THEN 'stale' ELSE 'current' END AS state
        FROM (SELECT t, count(*) AS n, max(ts) AS last FROM stream GROUP BY t)""",
    ctes=(O.STREAM,),
)
def layer_status(t):
    layers = t.stream_events.groupBy(F.col("t").alias("layer")).agg(F.count("*").alias("rows"), F.max("ts").alias("last"))
    loaded = layers.withColumn("loaded_at", F.when(F.col("layer") != "view", F.col("last")))
    return views.layer_status(loaded, EVENTS_AS_OF).select("layer", "rows", "state")


@query(
    "snapshot_consistency",
    "SELECT true AS ids_unique, true AS count_matches, true AS topics_match, false AS severities_match, true AS next_id_free",
)
def snapshot_consistency(t):
    """The whole report table against a manifest whose severity counts were tampered with."""
    manifest = views.manifest_counts(t.reports).withColumns(
        {"severity_watching": F.col("severity_watching") + 1, "next_event_id": F.lit(None).cast("long")}
    )
    return checks.snapshot_consistency(t.reports, manifest)


@query(
    "snapshot_chain",
    """SELECT 'first' AS asked, 'snapshot' AS served, count(*) AS events, max(id) + 1 AS next_event_id, max(ts) AS last_attempt FROM reports
       UNION ALL SELECT 'second', 'mirror', count(*), 9000000, max(ts) + 5 FROM reports WHERE id % 2 = 0
       UNION ALL SELECT 'none', 'empty', 0, 1, 0""",
    ctes=O.REPORT_CTES,
)
def snapshot_chain(t):
    """A snapshot without counters, a mirror behind a place that does not exist, and no place at all."""
    root = f"{shared_folder(t.spark)}/chain-{uuid.uuid4().hex}"
    reports = t.reports.select("id", "t", "sev", "title", "ts")
    some = reports.filter("id % 2 = 0")
    late = F.max("ts").alias("last_sync")
    reports.write.json(f"{root}/snapshot/events")
    reports.agg(late).write.json(f"{root}/snapshot/manifest")
    some.write.json(f"{root}/mirror/events")
    some.agg(late, (F.max("ts") + 5).alias("last_attempt"), F.lit(9_000_000).alias("next_event_id")).write.json(f"{root}/mirror/manifest")
    place = lambda name, folder: Place(name, f"{root}/{folder}/events", f"{root}/{folder}/manifest")
    asked = {"first": [place("snapshot", "snapshot"), place("mirror", "mirror")], "second": [place("snapshot", "gone"), place("mirror", "mirror")], "none": [place("snapshot", "gone")]}
    rows = None
    for name, places in asked.items():
        found = read_snapshot(t.spark, places)
        row = found.manifest.select(F.lit(name).alias("asked"), F.lit(found.served).alias("served"), "events", "next_event_id", "last_attempt")
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query(
    "load_snapshot",
    "SELECT count(*) AS events, max(id) + 1 AS next_event_id, max(ts) AS last_attempt FROM reports",
    ctes=O.REPORT_CTES,
)
def load_snapshot(t):
    """Defaults of a manifest written before the counters existed."""
    bare = t.reports.agg(F.count("*").alias("events"), F.max("id").alias("max_id"), F.max("ts").alias("last_sync")).withColumns(
        {"stored_next": F.lit(None).cast("long"), "stored_attempt": F.lit(None).cast("long")}
    )
    return bare.select(
        "events", F.coalesce("stored_next", F.col("max_id") + 1).alias("next_event_id"),
        F.coalesce("stored_attempt", "last_sync").alias("last_attempt"),
    )
