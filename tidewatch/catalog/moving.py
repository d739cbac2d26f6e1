"""Queries: position reports, trails, seismic points, host samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog import oracle as O
from tidewatch.catalog.registry import query
from tidewatch.functions import geo, times
from tidewatch.operators import hosts as H
from tidewatch.operators import history, tracks
from tidewatch.sources import records

# One published cycle per 6 hours and a 15-day horizon: at most 61 fixes per object.
CYCLE = 6 * times.HOUR_MS
POLICY = tracks.TrailPolicy(points=8, max_age_ms=15 * times.DAY_MS, min_move=20.0)

_STATES = """
states AS (
  SELECT event_id, 'AC' || CAST(user_id AS VARCHAR) AS icao, epoch_us(ts) // 1000000 AS time,
    epoch_us(ts) // 1000000 - event_id % 80 + 8 AS contact,
    CASE WHEN event_id % 40 = 0 THEN NULL ELSE event_id * 37 % 4000 / 10.0 - 200 END AS lon,
    event_id * 53 % 1900 / 10.0 - 95 AS lat,
    CASE WHEN event_id % 9 = 0 THEN -50.0 ELSE value * 100 END AS alt, value AS speed, CAST(event_id % 720 AS DOUBLE) AS track
  FROM events)
"""
_VALID = """lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND NOT (lat = 0 AND lon = 0) AND alt >= -20
            AND contact > 0 AND time - contact BETWEEN -5 AND 60"""


def _state_documents(t):
    """Each event as a one-vector state document, as the positional JSON array it would arrive in."""
    return t["events"].selectExpr(
        "event_id",
        """to_json(named_struct('time', ms div 1000, 'states', array(array(
             'AC' || CAST(user_id AS STRING), 'CALL ' || CAST(user_id AS STRING), 'Nowhere', CAST(NULL AS STRING),
             CAST(ms div 1000 - event_id % 80 + 8 AS STRING),
             CASE WHEN event_id % 40 = 0 THEN NULL ELSE CAST(event_id * 37 % 4000 / 10 - 200 AS STRING) END,
             CAST(event_id * 53 % 1900 / 10 - 95 AS STRING),
             CASE WHEN event_id % 9 = 0 THEN '-50.0' ELSE CAST(value * 100 AS STRING) END, 'false', CAST(value AS STRING),
             CAST(CAST(event_id % 720 AS DOUBLE) AS STRING), CAST(NULL AS STRING))))) AS body""".replace(
            "ms div 1000", "unix_seconds(CAST(ts AS TIMESTAMP))"
        ),
    )


@query("aircraft_fixes", "SELECT event_id, icao AS icao24, contact, lon, lat FROM states", ctes=(_STATES,))
def aircraft_fixes(t):
    rows = records.state_rows(_state_documents(t), "body", "event_id")
    return rows.select(
        "event_id", "icao24", F.col("last_contact").cast("long").alias("contact"), F.col("lon").cast("double").alias("lon"),
        F.col("lat").cast("double").alias("lat"),
    )


@query(
    "valid_fixes",
    f"""SELECT event_id, lower(icao) AS id, round(lon, 4) AS lon, round(lat, 4) AS lat, CAST(round_even(alt, 0) AS INTEGER) AS alt_m,
          nullif(round_even(track % 360, 1), NULL) AS raw_heading FROM states WHERE {_VALID}""",
    ctes=(_STATES,),
)
def valid_fixes(t):
    rows = records.state_rows(_state_documents(t), "body", "event_id")
    # Documents hold one vector each, so the input position is the document's.
    fixes = tracks.valid_fixes(rows.withColumn("pos", F.col("event_id")), F.col("clock"))
    heading = F.coalesce("heading", F.lit(0.0))
    return fixes.select(F.col("pos").alias("event_id"), "id", "lon", "lat", "alt_m", heading.alias("raw_heading"))


@query(
    "best_fix",
    """SELECT id, pos, alt_m FROM (SELECT id, pos, alt_m, row_number() OVER (PARTITION BY id ORDER BY alt_m DESC, pos) AS rn FROM fixes)
       WHERE rn = 1""",
    ctes=(O.FIXES,),
)
def best_fix(t):
    return tracks.best_fix(t.fixes).select("id", "pos", "alt_m")


@query(
    "aircraft_by_altitude",
    "SELECT id, pos, alt_m FROM fixes ORDER BY alt_m DESC, pos",
    ctes=(O.FIXES,),
)
def aircraft_by_altitude(t):
    return tracks.by_altitude(t.fixes).select("id", "pos", "alt_m")


def _cycle_fixes(t):
    """Best fix per object and cycle, stamped with the cycle's clock."""
    cycled = t.fixes.withColumn("clock", (F.floor(F.col("clock") / CYCLE) + 1) * CYCLE)
    return tracks.best_fix(cycled, "clock")


LAST_CYCLE = 1_706_659_200_000

_CYCLES = f"""
cycle_fixes AS (
  SELECT id, lon, lat, clock FROM (
    SELECT *, row_number() OVER (PARTITION BY id, clock ORDER BY alt_m DESC, pos) AS rn FROM (
      SELECT id, pos, lon, lat, alt_m, (clock // {CYCLE} + 1) * {CYCLE} AS clock FROM fixes)) WHERE rn = 1)
"""
_ALIVE = f"list_filter(acc, lambda p: p.ts >= x[1].ts - {POLICY.max_age_ms})[-8:]"


def _extend(alive: str) -> str:
    return f"""CASE WHEN len({alive}) = 0 OR abs({alive}[-1].lon - x[1].lon) > {POLICY.min_move}
      OR abs({alive}[-1].lat - x[1].lat) > {POLICY.min_move} OR x[1].ts - {alive}[-1].ts >= {POLICY.max_age_ms // 8}
      THEN list_concat({alive}, x)[-8:] ELSE {alive} END"""


def _folded(name: str, as_of: int) -> str:
    return f"""
{name} AS (
  SELECT id, list_reduce(list([{{'lon': lon, 'lat': lat, 'ts': clock}}] ORDER BY clock), lambda acc, x: {_extend(_ALIVE)}) AS trail
  FROM cycle_fixes WHERE clock BETWEEN {as_of} - {POLICY.max_age_ms} AND {as_of} GROUP BY id)
"""


@query(
    "trail_fold",
    "SELECT id, p.ts AS ts, p.lon AS lon, p.lat AS lat FROM (SELECT id, unnest(trail) AS p FROM folded)",
    ctes=(O.FIXES, _CYCLES, _folded("folded", LAST_CYCLE)),
)
def trail_fold(t):
    return tracks.fold_trails(_cycle_fixes(t), LAST_CYCLE, POLICY).select("id", F.inline("trail"))


_UPDATED = f"""
updated AS (
  SELECT id, {_extend("list_filter(coalesce(trail, []), lambda p: p.ts >= x[1].ts - " + str(POLICY.max_age_ms) + ")[-8:]")} AS trail
  FROM (SELECT c.id, [{{'lon': c.lon, 'lat': c.lat, 'ts': c.clock}}] AS x, f.trail
        FROM cycle_fixes c LEFT JOIN before_last f ON f.id = c.id WHERE c.clock = {LAST_CYCLE}))
"""


@query(
    "trail_update",
    "SELECT id, p.ts AS ts, p.lon AS lon, p.lat AS lat FROM (SELECT id, unnest(trail) AS p FROM updated)",
    ctes=(O.FIXES, _CYCLES, _folded("before_last", LAST_CYCLE - CYCLE), _UPDATED),
)
def trail_update(t):
    fixes = _cycle_fixes(t)
    previous = tracks.fold_trails(fixes, LAST_CYCLE - CYCLE, POLICY)
    current = fixes.filter(F.col("clock") == LAST_CYCLE)
    return tracks.update_trails(current, previous, POLICY).select("id", F.inline("trail"))


@query(
    "trail_rank",
    f"""SELECT id, newest, moved_km FROM (
          SELECT id, trail[-1].ts AS newest, round({O.haversine('trail[1].lon', 'trail[1].lat', 'trail[-1].lon', 'trail[-1].lat')}, 3) AS moved_km
          FROM folded WHERE len(trail) >= 2)
        ORDER BY (id = 'ac7') DESC, newest DESC, moved_km DESC, id LIMIT 28""",
    ctes=(O.FIXES, _CYCLES, _folded("folded", LAST_CYCLE)),
)
def trail_rank(t):
    trails = tracks.fold_trails(_cycle_fixes(t), LAST_CYCLE, POLICY)
    limit = tracks.zoom_tier(1.9e7)[1]
    ranked = tracks.rank_trails(trails, limit, pinned="ac7")
    return ranked.select("id", "newest", F.round("moved_km", 3).alias("moved_km"))


@query(
    "grid_thin",
    """SELECT id, pos FROM (
         SELECT id, pos, true AS pinned FROM best WHERE id = 'ac3'
         UNION ALL SELECT id, pos, false FROM (
           SELECT id, pos, row_number() OVER (PARTITION BY floor((lon + 180) / 7.5), floor((lat + 90) / 7.5) ORDER BY pos) AS rn
           FROM best WHERE id <> 'ac3') WHERE rn = 1)
       ORDER BY pinned DESC, pos LIMIT 320""",
    ctes=(O.FIXES, """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY alt_m DESC, pos) AS rn FROM fixes) WHERE rn = 1)"""),
)
def grid_thin(t):
    tier = tracks.zoom_tier(1.9e7)
    return tracks.thin_grid(tracks.best_fix(t.fixes), tier[4], tier[3], pinned="ac3").select("id", "pos")


@query(
    "grid_thin_reports",
    """SELECT pos FROM (SELECT pos, row_number() OVER (PARTITION BY floor((lon + 180) / 1.5), floor((lat + 90) / 1.5) ORDER BY pos) AS rn
       FROM fixes) WHERE rn = 1 ORDER BY pos LIMIT 1400""",
    ctes=(O.FIXES,),
)
def grid_thin_reports(t):
    tier = tracks.zoom_tier(1e6)
    return tracks.thin_grid(t.fixes, tier[4], tier[3]).select("pos")


@query(
    "seismic_points",
    """SELECT event_id, pos, mag FROM (
         SELECT event_id, 0 AS pos, value / 50 AS mag FROM events WHERE event_id % 10 <> 0
         UNION ALL SELECT event_id, 1, value / 20 FROM events) WHERE mag > 1.5""",
)
def seismic_points(t):
    body = """to_json(named_struct('features', array(
      named_struct('geometry', named_struct('coordinates', CASE WHEN event_id % 10 = 0 THEN array() ELSE array(10.0D, 20.0D) END),
                   'properties', named_struct('mag', value / 50, 'place', 'near')),
      named_struct('geometry', named_struct('coordinates', array(30.0D, CAST(event_id % 90 AS DOUBLE))),
                   'properties', named_struct('mag', value / 20, 'place', 'far'))))) AS body"""
    documents = t["events"].selectExpr("event_id", body)
    return records.seismic_points(documents, "body", "event_id").select("event_id", "pos", "mag")


_HOSTS = """
hosts AS (
  SELECT event_id, CAST(event_id % 12 AS INTEGER) AS region_pos,
    CASE WHEN event_id % 17 = 0 THEN '300.1.1.1' ELSE '10.' || CAST(event_id % 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) || '.1' END AS ip,
    event_id * 53 % 2000 / 10.0 - 100 AS latitude, event_id * 37 % 3600 / 10.0 - 180 AS longitude
  FROM events),
valid AS (SELECT * FROM hosts WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND ip NOT LIKE '300%')
"""


def _hosts(t):
    """One search result document per event, host nested as the provider nests it."""
    body = """to_json(named_struct('result', named_struct('total_hits', 1, 'hits', array(named_struct('host_v1', named_struct('resource',
      named_struct('ip', CASE WHEN event_id % 17 = 0 THEN '300.1.1.1'
          ELSE '10.' || CAST(event_id % 256 AS STRING) || '.' || CAST(user_id % 256 AS STRING) || '.1' END,
        'services', array(named_struct('port', 443), named_struct('port', CAST(event_id % 70000 AS INT)), named_struct('port', 443)),
        'location', named_struct('country_code', 'deu', 'coordinates', named_struct(
          'latitude', event_id * 53 % 2000 / 10 - 100, 'longitude', event_id * 37 % 3600 / 10 - 180)))))))))  AS body"""
    documents = t["events"].selectExpr("event_id", "CAST(event_id % 12 AS INT) AS region_pos", body)
    rows = records.host_rows(documents, "body", "event_id", "region_pos")
    return rows.withColumn("host_pos", F.col("event_id"))


@query(
    "valid_hosts",
    """SELECT event_id, ip, 'DE' AS country_code, CASE WHEN event_id % 70000 > 65535 OR event_id % 70000 = 443 THEN '443'
         WHEN event_id % 70000 < 443 THEN CAST(event_id % 70000 AS VARCHAR) || ',443' ELSE '443,' || CAST(event_id % 70000 AS VARCHAR) END AS ports
       FROM valid""",
    ctes=(_HOSTS,),
)
def valid_hosts(t):
    return H.valid_hosts(_hosts(t)).select(
        "event_id", "ip", "country_code", F.array_join(F.transform("ports", lambda p: p.cast("string")), ",").alias("ports")
    )


@query(
    "host_sample",
    """SELECT region_pos, event_id, 'box ' || printf('%.2f', region_pos - 20.0) || '/' || printf('%.2f', region_pos * 10.0) AS label FROM (
         SELECT *, row_number() OVER (PARTITION BY region_pos ORDER BY event_id) AS rn FROM valid WHERE region_pos < 8)
       WHERE rn <= 30 ORDER BY region_pos, event_id LIMIT 300""",
    ctes=(_HOSTS,),
)
def host_sample(t):
    sample = H.host_sample(H.valid_hosts(_hosts(t)))
    box = sample.withColumns(
        {
            "kind": F.lit("bbox"), "name": F.lit(None).cast("string"), "south": F.col("region_pos") - 20.0,
            "west": F.col("region_pos") * 10.0,
        }
    )
    return box.select("region_pos", "event_id", H.region_label().alias("label"))


_BOX = """
boxes AS (
  SELECT event_id, CAST(event_id * 37 % 360 - 180 AS DOUBLE) AS west, CAST(event_id * 53 % 360 - 180 AS DOUBLE) AS east,
    CAST(event_id % 80 - 80 AS DOUBLE) AS south, CAST(event_id % 90 AS DOUBLE) AS north FROM events),
spans AS (SELECT *, (south + north) / 2 AS lat, CASE WHEN west > east THEN east - west + 360 ELSE east - west END AS span FROM boxes)
"""


@query(
    "bbox_circle",
    """SELECT event_id, lat, (west + span / 2 + 180) - 360 * floor((west + span / 2 + 180) / 360) - 180 AS lon,
         greatest(50, CAST(floor(sqrt(pow((north - south) * 111.0, 2) + pow(span * 111.0 * cos(radians(lat)), 2)) / 2) AS INTEGER)) AS radius_km
       FROM spans""",
    ctes=(_BOX,),
)
def bbox_circle(t):
    e = F.col("event_id")
    boxes = t["events"].select(
        "event_id", F.lit("bbox").alias("kind"), (e * 37 % 360 - 180).cast("double").alias("west"),
        (e * 53 % 360 - 180).cast("double").alias("east"), (e % 80 - 80).cast("double").alias("south"), (e % 90).cast("double").alias("north"),
    )
    return boxes.select("event_id", H.region_circle().alias("c")).select("event_id", "c.lat", "c.lon", "c.radius_km")


@query(
    "haversine",
    f"""SELECT pos, round({O.haversine('lon', 'lat', '2.3522', '48.8566')}, 3) AS km FROM fixes""",
    ctes=(O.FIXES,),
)
def haversine(t):
    km = geo.haversine_km(F.col("lon"), F.col("lat"), F.lit(2.3522), F.lit(48.8566))
    return t.fixes.select("pos", F.round(km, 3).alias("km"))


@query(
    "duration_stats",
    """SELECT event_type, count(*) AS reps, min(value) AS min_ms, median(value) AS median_ms, max(value) AS max_ms FROM events GROUP BY event_type""",
)
def duration_stats(t):


    return history.duration_stats(t["events"], "event_type", F.col("value"))


