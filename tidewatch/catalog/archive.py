"""Queries: revision history, comparison, ledgers, audits, integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog import oracle as O
from tidewatch.catalog.registry import query
from tidewatch.catalog.stories import fold
from tidewatch.functions import hashing, urls
from tidewatch.operators import audit, checks, history
from tidewatch.operators import contract_paths as P
from tidewatch.sources.tables import AS_OF

# Sources of the history: reports' articles under two providers.
_OBSERVED = """
observed AS (
  SELECT a.seq, CASE WHEN a.seq % 4 = 0 THEN 'gdelt' ELSE 'rss' END AS provider, a.url, a.title, j.outcome,
    CASE WHEN a.seq % 4 = 0 THEN 'gdelt' ELSE 'rss' END || '|url:' || a.url AS natural_key
  FROM articles a JOIN judged j ON j.seq = a.seq WHERE a.seq % 13 <> 0)
"""
_OBSERVED_CTES = (O.ARTICLES, O.JUDGED, _OBSERVED)


def observed(t):
    """Every article as observed by its provider; each 13th has an unusable address."""
    judged = t.judged.select("seq", "outcome")
    articles = t.articles.select(
        "seq", F.when(F.col("seq") % 4 == 0, "gdelt").otherwise("rss").alias("provider"),
        F.when(F.col("seq") % 13 == 0, "ftp://nowhere/x").otherwise(F.col("url")).alias("url"),
        "title", F.lit("").alias("summary"), "seendate",
    )
    return history.observe(articles.join(judged, "seq"))


@query(
    "source_records",
    "SELECT natural_key, arg_min(url, seq) AS original_url FROM observed GROUP BY natural_key",
    ctes=_OBSERVED_CTES,
)
def source_records(t):
    return history.new_sources(observed(t)).select("natural_key", "original_url")


@query(
    "source_revisions",
    """SELECT natural_key, title, min(ts) AS published_at FROM (
         SELECT o.natural_key, o.title, arg_min(a.ts, o.seq) AS ts FROM observed o JOIN articles a ON a.seq = o.seq GROUP BY ALL) GROUP BY ALL""",
    ctes=_OBSERVED_CTES,
)
def source_revisions(t):
    seen = observed(t)
    keys = history.new_sources(seen).select("source_uid", "natural_key")
    revisions = history.new_source_revisions(seen, AS_OF)
    return revisions.join(keys, "source_uid").select("natural_key", "title", "published_at")


@query(
    "source_observations",
    """SELECT natural_key, title, arg_min(outcome, seq) AS outcome FROM (
         SELECT natural_key, title, seq, outcome FROM observed) GROUP BY ALL""",
    ctes=_OBSERVED_CTES,
)
def source_observations(t):
    seen = observed(t)
    keys = history.new_sources(seen).select("source_uid", "natural_key")
    titles = history.new_source_revisions(seen, AS_OF).select("revision_uid", "title")
    rows = history.new_observations(seen, "run-1", AS_OF)
    return rows.join(keys, "source_uid").join(titles, "revision_uid").select(
        "natural_key", "title", F.col("normalization_outcome").alias("outcome")
    )


@query(
    "repeat_run_appends_nothing",
    "SELECT 0 AS sources, 0 AS revisions, 0 AS observations",
)
def repeat_run_appends_nothing(t):
    """The same batch against its own history."""
    seen = observed(t)
    again = [
        history.new_sources(seen, history.new_sources(seen)).agg(F.count("*").alias("sources")),
        history.new_source_revisions(seen, AS_OF, history.new_source_revisions(seen, AS_OF)).agg(F.count("*").alias("revisions")),
        history.new_observations(seen, "r", AS_OF, history.new_observations(seen, "r", AS_OF)).agg(F.count("*").alias("observations")),
    ]
    one = [df.withColumn("one", F.lit(1)) for df in again]
    return one[0].join(one[1], "one").join(one[2], "one").drop("one")


@query(
    "batch_outcomes",
    """SELECT provider, count(*) FILTER (WHERE outcome = 'accepted' AND seq % 13 <> 0) AS accepted,
         count(*) FILTER (WHERE NOT (outcome = 'accepted' AND seq % 13 <> 0)) AS rejected
       FROM (SELECT seq, outcome, CASE WHEN seq % 4 = 0 THEN 'gdelt' ELSE 'rss' END AS provider FROM judged) GROUP BY provider""",
    ctes=(O.ARTICLES, O.JUDGED),
)
def batch_outcomes(t):
    return history.batch_outcomes(observed(t))


@query(
    "source_health",
    """SELECT * FROM (VALUES ('gdelt', 'failed', 'source_failure'), ('osint', 'empty', NULL), ('rss', 'ok', NULL)) v(provider, state, error_code)
       WHERE (SELECT count(*) FROM articles WHERE seq % 4 <> 0) > 0""",
    ctes=(O.ARTICLES,),
)
def source_health(t):
    return history.source_health(observed(t), "run-1", ["gdelt"], ["rss", "gdelt", "osint"]).drop("run_uid")


@query(
    "cycle_health",
    """SELECT count(*) FILTER (WHERE failed) AS failed_sources, count(*) FILTER (WHERE NOT failed) AS succeeded_sources,
         CAST(sum(rejected) AS BIGINT) AS rejected, 'degraded' AS status
       FROM (SELECT source, count(*) FILTER (WHERE lang <> 'en') AS rejected, count(*) FILTER (WHERE lang = 'en') = 0 OR source = 'src9' AS failed
             FROM documents GROUP BY source)""",
)
def cycle_health(t):
    sources = t["documents"].groupBy("source").agg(
        F.count_if(F.col("lang") != "en").alias("rejected"),
        ((F.count_if(F.col("lang") == "en") == 0) | (F.first("source") == "src9")).alias("failed"),
    )
    return history.cycle_health(sources, F.sum("rejected"))


@query(
    "revision_chain",
    """SELECT source, content, first_seen, last_seen, observations, row_number() OVER (PARTITION BY source ORDER BY first_seen) AS revision
       FROM (SELECT source, content, min(doc_id) AS first_seen, max(doc_id) AS last_seen, count(*) AS observations
             FROM (SELECT source, sha256(text) AS content, doc_id FROM documents) GROUP BY ALL)""",
)
def revision_chain(t):
    """Distinct bodies per outlet over the whole texts."""
    chain = history.revision_chain(t["documents"], "source", t.doc_span, F.col("text"))
    return chain.withColumnRenamed("content_hash", "content")


@query(
    "latest_revision",
    """SELECT conv_id, turn, sha256(text) AS content FROM (
         SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1""",
)
def latest_revision(t):
    newest = history.latest(t["conversations"], ["conv_id"], F.col("turn").desc())
    return newest.select("conv_id", "turn", F.sha2("text", 256).alias("content"))


@query(
    "event_revisions",
    """SELECT conv_id, count(*) AS revisions FROM (SELECT DISTINCT conv_id, CASE WHEN turn % 3 = 2 THEN 0 ELSE turn END AS state FROM conversations)
       GROUP BY conv_id""",
)
def event_revisions(t):
    """Conversations as events whose content returns to its first state every third turn: no revision on return."""
    c = F.col
    states = t["conversations"].select(
        urls.name_uid("event", c("conv_id")).alias("event_uid"), "conv_id", "turn",
        hashing.fingerprint({}, {"state": F.when(c("turn") % 3 == 2, 0).otherwise(c("turn"))}).alias("semantic_hash"),
    )
    firsts = states.groupBy("event_uid", "semantic_hash").agg(F.min("turn").alias("turn"), F.first("conv_id").alias("conv_id"))
    revisions = history.new_event_revisions(firsts, AS_OF)
    return revisions.groupBy("conv_id").agg(F.count("*").alias("revisions"))


@query(
    "event_evidence",
    """SELECT s.id, count(DISTINCT o.natural_key || o.title) AS evidence FROM stories s
       JOIN members m ON m.id = s.id JOIN (
         SELECT url, natural_key, title FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq DESC) AS rn FROM observed) WHERE rn = 1) o
         ON o.url = m.url GROUP BY s.id""",
    ctes=(*O.STORY_CTES, _OBSERVED),
)
def event_evidence(t):


    events, sources = fold(t)
    revisions = history.new_event_revisions(history.semantic_events(events, sources), AS_OF)
    links = history.new_evidence(revisions, sources, observed(t))
    named = revisions.select("id", F.col("revision_uid").alias("event_revision_uid"))
    return links.join(named, "event_revision_uid").groupBy("id").agg(F.count("*").alias("evidence"))


@query(
    "import_mapping",
    """SELECT id, id % 5 = 0 AS conflict FROM reports""",
    ctes=O.REPORT_CTES,
)
def import_mapping(t):
    """A second import over live events, and over events of a different import (conflicts)."""
    events = t.reports.select("id")
    known = history.import_mapping(events, "first").filter(F.col("id") % 2 == 0)
    clashing = history.import_mapping(events, "other").filter(F.col("id") % 5 == 0)
    before = known.filter(F.col("id") % 5 != 0).unionByName(clashing)
    return history.import_mapping(events, "first", before).select("id", "conflict")


_UID = (
    "substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' "
    "|| substr('89ab', CAST(CAST('0x' || substr(d, 17, 1) AS BIGINT) % 4 + 1 AS BIGINT), 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12)"
)
_FOLDS = " || ':' || ".join(f"bit_xor(CAST('0x' || substr(h, {i}, 15) AS BIGINT))" for i in (1, 16, 31, 46))


@query(
    "mapping_checksum",
    f"""SELECT count(*) AS n, sha256(count(*) || ':' || sum(id) || ':' || {_FOLDS}) AS checksum
       FROM (SELECT id, sha256(id || '=' || {_UID}) AS h FROM (SELECT id, sha1('event|' || id) AS d FROM reports))""",
    ctes=O.REPORT_CTES,
)
def mapping_checksum(t):
    return history.mapping_checksum(history.import_mapping(t.reports.select("id"), "first"))


@query(
    "content_fingerprint",
    """SELECT p_partkey, sha256('{"name":"' || p_name || '","price":' || CASE WHEN p_retailprice = floor(p_retailprice)
         THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END
         || ',"size":' || CAST(p_size AS VARCHAR) || ',"type":"' || p_type || '"}') AS fingerprint FROM part""",
)
def content_fingerprint(t):
    c = F.col
    return t["part"].select(
        "p_partkey",
        hashing.fingerprint({"name": c("p_name"), "type": c("p_type")}, {"size": c("p_size"), "price": c("p_retailprice")}).alias("fingerprint"),
    )


@query(
    "content_json",
    """SELECT o_orderkey, '{"key":' || CAST(o_orderkey AS VARCHAR) || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}' AS body
       FROM orders""",
)
def content_json(t):
    c = F.col
    body = hashing.canonical_json(
        {"status": c("o_orderstatus"), "priority": c("o_orderpriority")}, {"key": c("o_orderkey").cast("double")}
    )
    return t["orders"].select("o_orderkey", body.alias("body"))


@query(
    "current_projection",
    """SELECT id, title, last_seen FROM (
         SELECT r.id, r.title, r.ts AS last_seen FROM reports r WHERE id % 3 <> 0)""",
    ctes=O.REPORT_CTES,
)
def current_projection(t):
    """Imported, active events joined to the revision their current pointer names."""
    events = t.reports.select("id", urls.name_uid("event", F.col("id")).alias("event_uid"), (F.col("id") % 3 != 0).alias("active"))
    versions = t.reports.select(
        urls.name_uid("event", F.col("id")).alias("event_uid"), "title", "ts",
        F.explode(F.array(F.lit(0), F.lit(1))).alias("version"),
    ).withColumn("created_at", F.col("ts") + F.col("version") - 1)
    versions = versions.withColumn("revision_uid", urls.name_uid("revision", F.col("event_uid"), F.col("version")))
    current = history.current_revisions(versions)
    joined = events.filter("active").join(current, "event_uid")
    return joined.select("id", "title", F.col("created_at").alias("last_seen"))


@query(
    "compare_projection",
    """SELECT id, 'only_left' AS difference FROM reports WHERE id % 10 = 1
       UNION ALL SELECT id + 10000000, 'only_right' FROM reports WHERE id % 10 = 2
       UNION ALL SELECT id, 'only_left' FROM reports WHERE id % 10 = 2
       UNION ALL SELECT id, 'title' FROM reports WHERE id % 10 = 3
       UNION ALL SELECT id, 'lat' FROM reports WHERE id % 10 = 3 UNION ALL SELECT id, 'sev' FROM reports WHERE id % 10 = 4""",
    ctes=O.REPORT_CTES,
)
def compare_projection(t):
    i = F.col("id")
    fields = ["title", "loc", "lat", "lon", "sev", "t"]
    left = t.reports.select("id", *fields, F.lit(True).alias("present"))
    right = left.filter(i % 10 != 1).withColumns(
        {
            "title": F.when(i % 10 == 3, "Changed title").otherwise(F.col("title")),
            "lat": F.when(i % 10 == 3, F.col("lat") + 1).otherwise(F.col("lat")),
            "sev": F.when(i % 10 != 4, F.col("sev")),
        }
    ).withColumn("id", F.when(i % 10 == 2, i + 10_000_000).otherwise(i))
    return history.compare_projections(left, right, fields).select("id", "difference")


@query(
    "run_ledger",
    """SELECT run, CASE WHEN n = 1 THEN 'running' WHEN run % 7 = 0 THEN 'error' WHEN run % 3 = 0 THEN 'degraded' ELSE 'ok' END AS outcome
       FROM (SELECT o_custkey AS run, count(*) AS n FROM orders GROUP BY o_custkey)""",
)
def run_ledger(t):
    """Orders of a customer as ledger rows of a run: the first begins it, later ones finish it."""
    c = F.col
    first = F.min("o_orderkey")
    begun = t["orders"].groupBy("o_custkey").agg(first.alias("begin"), F.max("o_orderkey").alias("last"))
    rows = begun.select(
        c("o_custkey").alias("run_uid"),
        F.inline(F.array(
            F.struct(c("begin").alias("logged_at"), F.lit(0).alias("entry"), F.lit("running").alias("outcome")),
            F.struct(
                c("last").alias("logged_at"), F.when(c("last") == c("begin"), -1).otherwise(1).alias("entry"),
                F.when(c("o_custkey") % 7 == 0, "error").when(c("o_custkey") % 3 == 0, "degraded").otherwise("ok").alias("outcome"),
            ),
        )),
    )
    return history.latest_runs(rows).select(c("run_uid").alias("run"), "outcome")


@query(
    "coverage_gaps",
    """SELECT user_id, arg_max(event_type, event_id) AS reason, CASE WHEN user_id % 3 = 0 THEN 'reconciled' ELSE 'open' END AS state
       FROM events GROUP BY user_id""",
)
def coverage_gaps(t):
    gaps = t["events"].select(F.col("user_id").alias("run_uid"), F.col("event_type").alias("reason"), F.col("event_id").alias("seen_at"))
    committed = gaps.filter(F.col("run_uid") % 3 == 0).select("run_uid")
    return history.coverage_gaps(gaps, committed).select(F.col("run_uid").alias("user_id"), "reason", "state")


_DRIFT = """
drifted AS (
  SELECT seq, outcome, CASE WHEN lat <> 48.8566 THEN 'preservedSource' WHEN seq % 3 = 0 THEN 'updated' WHEN seq % 3 = 1 THEN 'quarantined' ELSE 'unchanged' END AS action
  FROM judged WHERE outcome = 'accepted')
"""


def _stored(t):
    """Stored events, some of whose coordinates or titles no longer agree with the text."""
    s = F.col("seq") % 3
    from_text = F.col("geo_source") == "title"
    return t.reports.withColumns(
        {
            "lat": F.when(from_text & (s == 0), F.col("lat") + 0.5).otherwise(F.col("lat")),
            "title": F.when(from_text & (s == 1), "Ransomware hits an unnamed grid").otherwise(F.col("title")),
        }
    )


@query("geo_audit", "SELECT seq + 1 AS id, action FROM drifted", ctes=(O.ARTICLES, O.JUDGED, _DRIFT))
def geo_audit(t):
    return audit.geo_audit(_stored(t)).select("id", "action")


@query(
    "geo_violations",
    "SELECT seq + 1 AS id FROM drifted WHERE action IN ('updated', 'quarantined')",
    ctes=(O.ARTICLES, O.JUDGED, _DRIFT),
)
def geo_violations(t):
    return audit.geo_violations(_stored(t)).select("id")


@query(
    "payload_integrity",
    "SELECT o_orderkey FROM orders WHERE o_orderkey % 50 = 0",
)
def payload_integrity(t):
    body = F.to_json(F.struct("o_orderkey", "o_orderstatus", "o_totalprice"))
    jobs = t["orders"].select("o_orderkey", body.alias("payload"), F.sha2(body, 256).alias("payload_hash")).withColumn(
        "payload", F.when(F.col("o_orderkey") % 50 == 0, F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))
    )
    return checks.payload_mismatches(jobs).select("o_orderkey")


@query(
    "index_violations",
    """SELECT rule, count(*) AS entries FROM (
         SELECT 'path_mismatch' AS rule FROM orders WHERE o_orderkey % 9 IN (0, 1, 2)
         UNION ALL SELECT 'path_outside' FROM orders WHERE o_orderkey % 9 = 0
         UNION ALL SELECT 'path_unsafe' FROM orders WHERE o_orderkey % 9 = 1
         UNION ALL SELECT 'duplicate_event_id' FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1)) GROUP BY rule""",
)
def index_violations(t):
    c = F.col
    uid = urls.name_uid("event", c("o_orderkey"))
    prefix = F.when(c("o_orderkey") % 9 == 0, "/elsewhere/").otherwise("/data/intelligence/v1/releases/")
    middle = F.when(c("o_orderkey") % 9 == 1, "rel/../events/").when(c("o_orderkey") % 9 == 2, "other/events/").otherwise("rel/events/")
    entries = t["orders"].select(
        F.lit("rel").alias("release_uid"), c("o_custkey").alias("event_id"), uid.alias("event_uid"),
        F.concat(prefix, middle, uid, F.lit(".json")).alias("artifact_path"),
    )
    return checks.index_violations(entries).groupBy("rule").agg(F.count("*").alias("entries"))


@query(
    "dangling_refs",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 11 = 0",
)
def dangling_refs(t):
    """Lines as references into orders, with the orders of every 11th key missing."""
    c = F.col
    children = t["lineitem"].select(c("l_orderkey"), "l_linenumber", c("l_orderkey").alias("ref"), F.lit("release").alias("scope"))
    parents = t["orders"].filter(c("o_orderkey") % 11 != 0).select(F.lit("release").alias("scope"), c("o_orderkey").alias("key"))
    # Lines of orders absent from the table would dangle too; the tables have none.
    return checks.dangling(children, parents, "scope", "ref", "key").select("l_orderkey", "l_linenumber")


_DETAIL_RULES = (
    "mention_evidence_missing", "offset_invalid", "offset_unpaired", "metadata_with_excerpt", "source_text_empty",
    "removed_with_excerpt", "related_self", "timeline_evidence_missing", "duplicate_evidence", "reason_entity_missing",
)


@query(
    "detail_violations",
    "SELECT rule, count(*) AS artifacts FROM (SELECT CASE doc_id % 11 "
    + " ".join(f"WHEN {i} THEN '{rule}'" for i, rule in enumerate(_DETAIL_RULES))
    + " END AS rule FROM documents) WHERE rule IS NOT NULL GROUP BY rule",
)
def detail_violations(t):
    """One artifact per document, each broken in one way or sound."""
    k = "doc_id % 11"
    artifact = f"""named_struct(
      'eventUid', CAST(doc_id AS STRING),
      'evidence', array(
        named_struct('evidenceUid', 'e1', 'reportingOriginUid', CAST(NULL AS STRING),
          'evidenceKind', IF({k} = 3, 'metadata_only', 'source_text'), 'status', IF({k} = 5, 'removed', 'active'),
          'excerpt', IF({k} = 4, '', substring(text, 1, 40) || '.')),
        named_struct('evidenceUid', IF({k} = 8, 'e1', 'e2'), 'reportingOriginUid', 'e1', 'evidenceKind', 'metadata_only', 'status', 'active',
          'excerpt', CAST(NULL AS STRING))),
      'entities', array(named_struct('entityUid', 'n1', 'mentions', array(named_struct('mentionUid', 'm1',
          'evidenceUid', IF({k} = 0, 'e9', 'e1'), 'start', IF({k} = 1, 9, 2), 'end', IF({k} = 2, CAST(NULL AS INT), 5))))),
      'timeline', array(named_struct('entryUid', 't1', 'evidenceUids', array(IF({k} = 7, 'e9', 'e1')))),
      'related', array(named_struct('target', named_struct('eventUid', IF({k} = 6, CAST(doc_id AS STRING), 'other')),
          'reasons', array(named_struct('entityUid', IF({k} = 9, 'n9', 'n1'), 'evidenceUids', array('e1')))))) AS a"""
    rows = t["documents"].selectExpr("doc_id", "text", artifact).select("a.*")
    return rows.select(F.explode(checks.detail_violations()).alias("rule")).groupBy("rule").agg(F.count("*").alias("artifacts"))


_BROKEN_PATHS = {
    0: [(".entities[].mentions[].surprise", "unknown_field")], 1: [(".evidence", "array_bound")], 2: [(".related[].target.eventId", "wrong_type")],
    3: [("", "not_json")], 4: [(".truncated.note", "unknown_field"), (".entities[].mentions", "array_bound")], 5: [(".generatedAt", "wrong_type")],
    6: [(".related[].reasons[].evidenceUids[]", "wrong_type")], 7: [(".extra", "unknown_field")],
}


@query(
    "contract_paths",
    "SELECT doc_id, path, rule FROM documents JOIN (VALUES "
    + ", ".join(f"({k}, '{path}', '{rule}')" for k, rows in _BROKEN_PATHS.items() for path, rule in rows)
    + ") v(k, path, rule) ON doc_id % 9 = k",
)
def contract_paths(t):
    """A detail artifact of every document's text, broken in one or two places, or sound."""
    k = "doc_id % 9"
    payload = f"""CASE WHEN {k} = 3 THEN '{{"eventUid": ' ELSE to_json(named_struct(
      'schemaVersion', 1, 'eventUid', CAST(doc_id AS STRING), 'generatedAt', CASE WHEN {k} = 5 THEN 'noon' END, 'extra', IF({k} = 7, array(array(1)), NULL),
      'evidence', array_repeat(named_struct('evidenceUid', 'e1', 'title', substring(text, 1, 60), 'publishedAt', CAST(NULL AS BIGINT)), IF({k} = 1, 21, 20)),
      'entities', array(named_struct('entityUid', 'n1', 'mentions', array_repeat(named_struct('role', 'subject', 'start', 2, 'surprise', IF({k} = 0, named_struct('a', 1), NULL)), IF({k} = 4, 6, 5)))),
      'related', array(named_struct('target', named_struct('eventId', IF({k} = 2, 1.5, NULL)), 'reasons', array(named_struct('evidenceUids', IF({k} = 6, array('1', NULL), array('1')))))),
      'truncated', named_struct('evidence', true, 'note', IF({k} = 4, 'x', NULL)))) END AS payload"""
    return P.contract_violations(t["documents"].selectExpr("doc_id", payload), "doc_id", "payload", P.DETAIL)


@query(
    "detail_mismatches",
    """SELECT o_orderkey AS event, 'eventUid' AS field FROM orders WHERE o_orderkey % 6 = 0
       UNION ALL SELECT o_orderkey, 'releaseUid' FROM orders WHERE o_orderkey % 6 = 1
       UNION ALL SELECT o_orderkey, 'projectionHash' FROM orders WHERE o_orderkey % 6 = 2""",
)
def detail_mismatches(t):
    c = F.col
    index = t["orders"].filter(c("o_orderkey") % 6 != 0).select(
        c("o_orderkey").alias("eventUid"), F.lit("r1").alias("releaseUid"), F.lit("v1").alias("eventRevisionUid"), c("o_orderstatus").alias("projectionHash")
    )
    details = t["orders"].select(
        c("o_orderkey").alias("eventUid"), F.when(c("o_orderkey") % 6 == 1, "r0").otherwise("r1").alias("releaseUid"),
        F.lit("v1").alias("eventRevisionUid"), F.when(c("o_orderkey") % 6 == 2, "stale").otherwise(c("o_orderstatus")).alias("projectionHash"),
    )
    return checks.detail_mismatch(details, index).select(c("eventUid").alias("event"), "field")


