"""SQL counterparts of the derived views in ``tidewatch.sources.tables``."""

from __future__ import annotations

from tidewatch.functions import vocabulary as V
from tidewatch.sources.tables import AS_OF, EVENTS_AS_OF

DAY, HOUR = 86_400_000, 3_600_000

ARTICLES = """
articles AS (
  SELECT doc_id AS seq,
    CASE doc_id % 5 WHEN 0 THEN 'Ransomware hits grid' WHEN 1 THEN 'Tanker reports piracy'
         WHEN 2 THEN 'Troops and artillery advance' WHEN 3 THEN 'New tariff announced'
         ELSE 'Local sports match ends' END
    || CASE doc_id % 7 WHEN 0 THEN ' in Paris' WHEN 1 THEN ' near Kyiv' WHEN 2 THEN ' in the Red Sea'
         WHEN 3 THEN ' across Germany' WHEN 4 THEN ' to Tokyo' WHEN 5 THEN ' at Lagos' ELSE '' END
    || ', report ' || CAST(doc_id % 10 AS VARCHAR) AS title,
    'https://www.' || source || '.example/story/' || CAST(doc_id % 800 AS VARCHAR) AS url,
    source || '.example' AS domain,
    CASE lang WHEN 'en' THEN 'English' ELSE lang END AS language,
    CAST(doc_id % 31 - 15 AS DOUBLE) AS tone,
    CASE WHEN doc_id % 14 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(doc_id % 70 - 30 AS DOUBLE) END AS lat,
    CASE WHEN doc_id % 14 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(doc_id % 70 * 2 - 70 AS DOUBLE) END AS lon,
    1704067200000 + (doc_id % 3) * 86400000 + (doc_id % 24) * 3600000 AS ts,
    source AS src, text,
    CASE WHEN doc_id % 9 = 0 THEN 'https://img.example/' || CAST(doc_id AS VARCHAR) || '.jpg' END AS media_image,
    CASE WHEN doc_id % 11 = 0 THEN 'https://www.youtube.com/watch?v=video' || CAST(doc_id AS VARCHAR) END AS video_url
  FROM documents)
"""

TOPIC = "CASE " + " ".join(
    f"WHEN regexp_matches(title, '{pattern}', 'i') THEN '{name}'" for name, pattern in V.TOPIC_PATTERNS
) + " END"

SEVERITY = (
    f"CASE WHEN regexp_matches(title, '{V.CRITICAL_PATTERN}', 'i') OR tone <= -10 THEN 'critical' "
    "WHEN tone <= -5 THEN 'escalating' WHEN tone >= 5 THEN 'deesc' ELSE 'watching' END"
)


def strip(expression: str) -> str:
    return f"trim({expression}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))"


# A lat/lon of 0/0 only occurs on rows whose title says "in Paris".
JUDGED = f"""
judged AS (
  SELECT seq, title, url, domain, tone, ts, src, media_image, video_url,
    {TOPIC} AS t, {SEVERITY} AS sev,
    substr({strip('text')}, 1, 600) AS summary,
    CASE WHEN lat = 0 AND lon = 0 THEN 48.8566 ELSE lat END AS lat,
    CASE WHEN lat = 0 AND lon = 0 THEN 2.3522 ELSE lon END AS lon,
    CASE WHEN lat = 0 AND lon = 0 THEN 'Paris, FR (approximate)' ELSE 'XX' END AS loc,
    CASE WHEN lat = 0 AND lon = 0 THEN 'approximate' ELSE 'precise' END AS geo_tier,
    CASE WHEN lat = 0 AND lon = 0 THEN 'title' ELSE 'source' END AS geo_source,
    CAST(40 + CASE WHEN length(title) BETWEEN 30 AND 180 THEN 20 ELSE 0 END + 20
         + CASE WHEN abs(tone) >= 3 THEN 10 ELSE 0 END AS INTEGER) AS quality,
    CASE WHEN length(title) < 10 THEN 'dropped:short_title'
         WHEN NOT (lower(language) LIKE 'english%' OR lower(language) = 'en') THEN 'dropped:language'
         WHEN ({TOPIC}) IS NULL THEN 'dropped:topic' ELSE 'accepted' END AS outcome
  FROM articles)
"""


def confidence(quality: str, outlets: str, hours: str) -> str:
    return (
        f"greatest(1, least(97, 35 + CAST(round_even({quality} / 5.0, 0) AS INTEGER)"
        f" + least(greatest({outlets} - 1, 0) * 18, 40)"
        f" - CASE WHEN {hours} > 6 THEN CAST(floor(least(({hours} - 6) * (25.0 / 48), 25)) AS INTEGER) ELSE 0 END))"
    )


def age_hours(as_of: int, ms: str) -> str:
    return f"greatest(0.0, CAST({as_of} - {ms} AS DOUBLE) / 3600000)"


REPORTS = f"""
reports0 AS (
  SELECT *, seq + 1 AS id, ts + seq % 97 * {HOUR} AS ingested_at, CAST(seq % 4 + 1 AS INTEGER) AS n_sources
  FROM judged WHERE outcome = 'accepted'),
reports1 AS (
  SELECT *, {confidence('quality', 'n_sources', age_hours(AS_OF, 'ingested_at'))} AS confidence FROM reports0),
reports AS (SELECT *, (n_sources >= 2 OR confidence >= 85) AS pulse FROM reports1)
"""
REPORT_CTES = (ARTICLES, JUDGED, REPORTS)

STORY = """
    t || '|' || CAST(CAST(floor(lat * 10 + 0.5) AS BIGINT) AS VARCHAR) || '|'
      || CAST(CAST(floor(lon * 10 + 0.5) AS BIGINT) AS VARCHAR) || '|'
      || CAST(CAST(floor(ts / 86400000.0) AS BIGINT) AS VARCHAR) || '|'
      || substr(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'), 1, 60)
"""

# Two folds: reports published before 06:00 of their day are the known state, the rest arrive.
STORIES = f"""
keyed AS (
  SELECT seq, url, t, sev, title, ts, quality, lat, lon, media_image, video_url, sha1({STORY}) AS story_key,
         (ts // {HOUR}) % 24 < 6 AS early
  FROM judged WHERE outcome = 'accepted'),
firsts AS (SELECT *, row_number() OVER (PARTITION BY early, url ORDER BY seq) AS rn FROM keyed),
early_fresh AS (SELECT * FROM firsts WHERE early AND rn = 1),
late_fresh AS (SELECT * FROM firsts WHERE NOT early AND rn = 1 AND url NOT IN (SELECT url FROM early_fresh)),
early_heads AS (
  SELECT story_key, min(seq) AS seq, row_number() OVER (ORDER BY min(seq)) AS id FROM early_fresh GROUP BY story_key),
late_heads AS (
  SELECT story_key, min(seq) AS seq,
         (SELECT count(*) FROM early_heads) + row_number() OVER (ORDER BY min(seq)) AS id
  FROM late_fresh WHERE story_key NOT IN (SELECT story_key FROM early_heads) GROUP BY story_key),
heads AS (SELECT * FROM early_heads UNION ALL SELECT * FROM late_heads),
members AS (
  SELECT h.id, f.seq, f.url, f.early FROM heads h
  JOIN (SELECT * FROM early_fresh UNION ALL SELECT * FROM late_fresh) f ON f.story_key = h.story_key),
stories AS (
  SELECT h.id, h.seq, k.t, k.sev, k.title, k.ts, k.quality, k.lat, k.lon, h.story_key, m.articles, m.n_outlets
  FROM heads h JOIN keyed k ON k.seq = h.seq
  JOIN (SELECT id, count(*) AS articles,
               count(DISTINCT replace(regexp_extract(url, '://([^/?#]*)', 1), 'www.', '')) AS n_outlets
        FROM members GROUP BY id) m ON m.id = h.id)
"""
STORY_CTES = (ARTICLES, JUDGED, STORIES)

FIXES = """
fixes AS (
  SELECT event_id AS pos, 'ac' || CAST(user_id AS VARCHAR) AS id,
    event_id * 37 % 3600 / 10.0 - 180 AS lon, event_id * 53 % 1700 / 10.0 - 85 AS lat,
    CAST(floor(value * 100) AS INTEGER) AS alt_m, epoch_us(ts) // 1000 AS clock
  FROM events)
"""

STREAM = """
stream AS (
  SELECT event_id AS id, event_type AS t, epoch_us(ts) // 1000 AS ts, user_id, value, props FROM events)
"""

CITIES = """
city_rows AS (
  SELECT c_custkey AS pos, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' ' || CAST(c_custkey % 40 AS VARCHAR) AS name,
    CAST(c_nationkey AS VARCHAR) AS iso, c_custkey * 997 % 2000000 AS population,
    c_custkey * 71 % 3600 / 10.0 - 180 AS lon, c_custkey * 29 % 1700 / 10.0 - 85 AS lat
  FROM customer),
city_firsts AS (
  SELECT *, row_number() OVER (PARTITION BY iso, lower(name) ORDER BY pos) AS rn FROM city_rows WHERE population >= 30000),
cities AS (
  SELECT pos, name, iso, population, round(lon, 4) AS lon, round(lat, 4) AS lat FROM city_firsts WHERE rn = 1)
"""


def polygons(table: str, key: str) -> str:
    """Ring vertices (polygon_id, i, lon, lat), the first vertex repeated at the end."""
    corners = ((-1, 0), (-0.5, -1), (0.5, -1), (1, 0), (0.5, 1), (-0.5, 1), (-1, 0))
    rows = " UNION ALL ".join(
        f"SELECT polygon_id, {i} AS i, clon + hw * {dx} AS lon, clat + hh * {dy} AS lat FROM shapes"
        for i, (dx, dy) in enumerate(corners)
    )
    return f"""
shapes AS (
  SELECT CAST({key} AS BIGINT) AS polygon_id, CAST({key} * 47 % 300 - 150 AS DOUBLE) AS clon,
    CAST({key} * 31 % 120 - 60 AS DOUBLE) AS clat, CAST({key} % 5 + 4 AS DOUBLE) AS hw, CAST({key} % 4 + 3 AS DOUBLE) AS hh
  FROM {table}),
vertices AS ({rows})
"""


def haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    a = (
        f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    )
    return f"(2 * 6371.0 * atan2(sqrt({a}), sqrt(1 - {a})))"


__all__ = [name for name in dir() if name.isupper()] + ["strip", "confidence", "age_hours", "polygons", "haversine"]
