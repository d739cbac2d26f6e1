"""Queries: URL de-duplication, corroboration, identities, scores, media."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatch.catalog import oracle as O
from tidewatch.catalog.registry import query
from tidewatch.functions import times
from tidewatch.operators import corroborate as C
from tidewatch.operators import history, views
from tidewatch.operators.normalize import accepted, story_key
from tidewatch.operators.numbering import number, number_within
from tidewatch.plans.cycle import Batch, Policy, full_state, run_cycle
from tidewatch.plans.warehouse import Warehouse
from tidewatch.session import durable, shared_folder
from tidewatch.sources.tables import AS_OF


def _batches(t):
    """Accepted reports split by hour of day: what is known, and what arrives."""
    reports = durable(
        accepted(t.judged).select(
            "seq", "url", "t", "sev", "title", "summary", "src", "loc", "ts", "ingested_at", "quality", "lat", "lon",
            "tone", "geo_source", "media_image", "video_url",
        )
    )
    early = F.floor(F.col("ts") / times.HOUR_MS) % 24 < 6
    return reports.filter(early), reports.filter(~early)


def fold(t):
    """Two folds; returns (events, sources) with the ids each fold gave."""
    known, arriving = _batches(t)
    span = t.seq_span()
    no_events = known.limit(0).withColumns({"id": F.lit(0).cast("long"), "live_rank": F.lit(0).cast("long")})
    no_sources = known.limit(0).select(F.lit(0).cast("long").alias("id"), "seq", "url")
    first = C.merge_reports(known, no_events, no_sources, span, 1)
    state, sources = durable(first.new_events), durable(first.new_sources)
    next_id = state.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]
    second = C.merge_reports(arriving, state.withColumn("live_rank", F.col("seq")), sources, span, next_id)
    return state.unionByName(second.new_events.select(*state.columns)), sources.unionByName(second.new_sources)


@query(
    "dedupe_urls",
    """SELECT seq, url FROM (SELECT seq, url, row_number() OVER (PARTITION BY url ORDER BY seq) AS rn FROM judged WHERE outcome = 'accepted')
       WHERE rn = 1""",
    ctes=(O.ARTICLES, O.JUDGED),
)
def dedupe_urls(t):
    return C.first_per_url(accepted(t.judged).select("seq", "url"))


@query(
    "fresh_urls",
    "SELECT seq, url FROM late_fresh",
    ctes=O.STORY_CTES,
)
def fresh_urls(t):
    known, arriving = _batches(t)
    return C.unseen_urls(arriving.select("seq", "url"), known.select("url")).select("seq", "url")


@query(
    "corroborate",
    f"""SELECT id, seq, t, sev, title, articles, n_outlets, confidence, (articles >= 2 OR confidence >= 85) AS pulse FROM (
          SELECT *, {O.confidence('quality', 'n_outlets', O.age_hours(AS_OF + 12 * O.HOUR, str(AS_OF)))} AS confidence FROM stories)""",
    ctes=O.STORY_CTES,
)
def corroborate(t):
    events, sources = fold(t)
    scored = C.with_scores(events, C.source_totals(sources), AS_OF + 12 * times.HOUR_MS)
    return scored.select("id", "seq", "t", "sev", "title", "articles", "n_outlets", "confidence", "pulse")


@query("event_sources", "SELECT id, seq, url FROM members", ctes=O.STORY_CTES)
def event_sources(t):
    return fold(t)[1]


@query("fold_after_pruning", "SELECT id, seq, t, sev, title, articles, n_outlets FROM stories", ctes=O.STORY_CTES)
def fold_after_pruning(t):
    """Two whole cycles that show five events only and merge their deltas into a new base each time: no story is forgotten."""
    root = f"{shared_folder(t.spark)}/fold-{uuid.uuid4().hex}"
    policy = Policy(mode="legacy", live_limit=5, compact_after=1, buckets=16)
    early = durable(t.judged.filter(F.floor(F.col("ts") / times.HOUR_MS) % 24 < 6).select("seq"))
    for how in ("left_semi", "left_anti"):
        manifest = run_cycle(t.spark, root, Batch(durable(t.articles.join(early, "seq", how))), AS_OF, policy)
    events, _ = full_state(Warehouse(t.spark, root), manifest)
    return events.select("id", "seq", "t", "sev", "title", "articles", "n_outlets")


@query(
    "cycle_tallies",
    """SELECT (SELECT count(*) FROM articles) AS ingested, (SELECT count(*) FROM keyed) AS accepted,
         (SELECT count(*) FROM keyed) - (SELECT count(*) FROM early_fresh) - (SELECT count(*) FROM late_fresh) AS deduped,
         (SELECT count(*) FROM early_fresh) + (SELECT count(*) FROM late_fresh) - (SELECT count(*) FROM heads) AS merged,
         (SELECT count(*) FROM heads) AS created""",
    ctes=O.STORY_CTES,
)
def cycle_tallies(t):
    """Conservation: accepted = deduped + merged + created."""
    events, sources = fold(t)
    one = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("one", F.lit(1))
    joined = one(t["documents"], "ingested").join(
        t.judged.agg(F.count_if(F.col("outcome") == "accepted").alias("accepted")).withColumn("one", F.lit(1)), "one"
    ).join(one(events, "created"), "one").join(one(sources, "fresh"), "one")
    return joined.select(
        "ingested", "accepted", (F.col("accepted") - F.col("fresh")).alias("deduped"),
        (F.col("fresh") - F.col("created")).alias("merged"), "created",
    )


@query(
    "allocate_ids",
    """SELECT seq, row_number() OVER (ORDER BY seq) + 1000 AS id FROM judged WHERE outcome = 'accepted'""",
    ctes=(O.ARTICLES, O.JUDGED),
)
def allocate_ids(t):
    return number(accepted(t.judged).select("seq"), t.seq_span(), "id", start=1001)


@query(
    "story_positions",
    f"""SELECT seq, story_key, row_number() OVER (PARTITION BY story_key ORDER BY seq) AS position
        FROM (SELECT seq, sha1({O.STORY}) AS story_key FROM judged WHERE outcome = 'accepted')""",
    ctes=(O.ARTICLES, O.JUDGED),
)
def story_positions(t):
    keyed = story_key(accepted(t.judged)).select("seq", "story_key")
    return number_within(keyed, ["story_key"], t.seq_span(), "position")


@query(
    "outlets",
    """SELECT id, lower(replace(regexp_extract(url, '://([^/?#]*)', 1), 'www.', '')) AS host, min(seq) AS first_seq
       FROM members GROUP BY ALL""",
    ctes=O.STORY_CTES,
)
def outlets(t):
    return C.outlets(fold(t)[1])


_LAST_HINTS = """keyed_urls AS (
  SELECT url, nullif(arg_max(coalesce(media_image, ''), seq), '') AS media_image,
         nullif(arg_max(coalesce(video_url, ''), seq), '') AS video_url
  FROM articles GROUP BY url)"""


@query(
    "media_hints",
    """SELECT s.id, coalesce(CASE WHEN s.id % 5 = 0 THEN 'kept.jpg' END, i.image) AS image, v.video_url FROM stories s
       LEFT JOIN (SELECT m.id, arg_min(k.media_image, m.seq) AS image FROM members m JOIN keyed_urls k ON k.url = m.url
                  WHERE k.media_image IS NOT NULL GROUP BY m.id) i ON i.id = s.id
       LEFT JOIN (SELECT m.id, arg_min(k.video_url, m.seq) AS video_url FROM members m JOIN keyed_urls k ON k.url = m.url
                  WHERE k.video_url IS NOT NULL GROUP BY m.id) v ON v.id = s.id""",
    ctes=(*O.STORY_CTES, _LAST_HINTS),
)
def media_hints(t):
    """Hints of the batch by URL (a URL fetched twice keeps its last hint) onto events, some already illustrated."""
    events, sources = fold(t)
    last = t.articles.groupBy("url").agg(
        F.max(F.struct("seq", "media_image", "video_url")).alias("h")
    ).select("url", F.col("h.media_image").alias("image"), F.col("h.video_url").alias("video_url"))
    bare = events.select(
        "id", F.when(F.col("id") % 5 == 0, "kept.jpg").alias("image"), F.lit(None).cast("string").alias("video_url")
    )
    return C.media_hints(sources, last, bare)


@query("pulse_events", "SELECT id, confidence FROM reports WHERE pulse", ctes=O.REPORT_CTES)
def pulse_events(t):
    return t.reports.filter("pulse").select("id", "confidence")


@query(
    "backfill_scores",
    f"""SELECT id, CASE WHEN id % 3 = 0 OR id % 4 = 0 THEN derived ELSE 50 END AS confidence,
          CASE WHEN id % 3 = 0 OR id % 4 = 0 THEN n_sources ELSE 9 END AS corroborating, (id % 3 = 0 OR id % 4 = 0) AS backfilled
        FROM (SELECT *, {O.confidence('quality', 'n_sources', O.age_hours(AS_OF, 'ingested_at'))} AS derived FROM reports)""",
    ctes=O.REPORT_CTES,
)
def backfill_scores(t):
    legacy = t.reports.select(
        "id", "quality", "n_sources", "ingested_at", F.col("n_sources").alias("n_outlets"),
        F.when(F.col("id") % 3 != 0, 50).alias("confidence"), F.when(F.col("id") % 4 != 0, 9).alias("corroborating"),
    )
    return C.backfill_scores(legacy, AS_OF).select("id", "confidence", "corroborating", "backfilled")


_COUNTS = ", ".join(
    [f"count(*) FILTER (WHERE t = '{x}') AS topic_{x}" for x in ("cyber", "geopolitical", "maritime", "military")]
    + [f"count(*) FILTER (WHERE sev = '{x}') AS severity_{x}" for x in ("critical", "escalating", "watching", "deesc")]
)


@query(
    "manifest_counts",
    f"SELECT count(*) AS events, {_COUNTS}, count(*) FILTER (WHERE pulse) AS pulse FROM reports",
    ctes=O.REPORT_CTES,
)
def manifest_counts(t):
    return views.manifest_counts(t.reports)


@query(
    "high_water",
    "SELECT greatest(max(id) + 1, 700) AS next_id FROM reports",
    ctes=O.REPORT_CTES,
)
def high_water(t):
    return history.high_water(t.reports, 700)


@query(
    "url_pairs_union",
    """SELECT conv_id, count(DISTINCT host) AS hosts, count(*) AS turns FROM (
         SELECT conv_id, 'h' || CAST(turn % 3 AS VARCHAR) || '.example' AS host FROM conversations) GROUP BY conv_id""",
)
def url_pairs_union(t):
    """Distinct hosts over per-turn source links."""
    links = t["conversations"].select(
        F.col("conv_id").alias("id"), F.concat(F.lit("https://h"), (F.col("turn") % 3).cast("string"), F.lit(".example/x")).alias("url")
    )
    totals = C.source_totals(links)
    return totals.select(F.col("id").alias("conv_id"), F.col("n_outlets").alias("hosts"), F.col("articles").alias("turns"))
