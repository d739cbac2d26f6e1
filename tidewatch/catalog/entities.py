"""Queries: entity mentions, relations, evaluation, corrections."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidewatch.catalog.registry import query
from tidewatch.operators import aliases as A
from tidewatch.operators import near as N
from tidewatch.operators import relate as R
from tidewatch.session import durable

_PLANTED = """text || ' Advisory CVE-2024-' || CAST(1000 + doc_id % 97 AS STRING) || ' lists 10.0.' || CAST(doc_id % 50 AS STRING)
    || '.1, 2001:db8::' || CAST(doc_id % 7 AS STRING) || ' and 192.168.0.0/16, not 999.999.1.1, at host' || CAST(doc_id % 41 AS STRING) || '.co.uk.'"""
_BODY = f"bodies AS (SELECT doc_id, {_PLANTED} AS body FROM documents)"
_PATTERN = "|".join(R.ENTITY_PATTERNS.values())


def _bodies(t):
    """Whole document texts with planted indicators at the end."""
    return t["documents"].selectExpr("doc_id", f"{_PLANTED} AS body")


_FOUND = f"""
found AS (
  SELECT doc_id, raw, i, parts FROM (
    SELECT doc_id, regexp_extract_all(body, '{_PATTERN}') AS raws, string_split_regex(body, '{_PATTERN}') AS parts FROM bodies)
  , LATERAL (SELECT unnest(raws) AS raw, generate_subscripts(raws, 1) AS i)),
placed AS (
  SELECT f.doc_id, f.raw, CAST(list_sum(list_transform(f.parts[1:f.i], lambda p: length(p))) AS BIGINT) AS gaps, f.i,
    CAST(coalesce(sum(length(f.raw)) OVER (PARTITION BY f.doc_id ORDER BY f.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM found f)
"""
_KIND = "CASE " + " ".join(f"WHEN regexp_full_match(raw, '{p}') THEN '{k}'" for k, p in R.ENTITY_PATTERNS.items()) + " END"


@query(
    "entity_mentions",
    f"""SELECT doc_id, {_KIND} AS kind, raw, gaps + before AS start FROM placed""",
    ctes=(_BODY, _FOUND),
)
def entity_mentions(t):
    return R.entity_mentions(_bodies(t), "doc_id", "body").select("doc_id", "kind", "raw", F.col("start").cast("long").alias("start"))


@query(
    "address_scopes",
    f"""SELECT doc_id, raw, CASE {" ".join(f"WHEN regexp_matches(raw, '{p}') THEN '{s}'" for s, p in R.ADDRESS_SCOPES.items())}
         ELSE 'global' END AS scope FROM found WHERE {_KIND} = 'ip'""",
    ctes=(_BODY, _FOUND),
)
def address_scopes(t):
    found = R.entity_mentions(_bodies(t), "doc_id", "body").filter(F.col("kind") == "ip")
    return found.select("doc_id", "raw", R.address_scope(F.col("raw")).alias("scope"))


# Reviewed aliases: nations, regions, and the first three and first two words of every benchmark passage. What two of
# them share is ambiguous. Bodies are whole texts, some of which hold such passages, with one harmed nation at the end.
_ALIASES = r"""
nations AS (SELECT n_nationkey, n_name FROM nation),
bench AS (SELECT item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM benchmark),
aliases AS (
  SELECT trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS alias, 'country' AS kind, n_name AS value FROM nation
  UNION ALL SELECT trim(regexp_replace(lower(r_name), '[^a-z0-9]+', ' ', 'g')), 'region', r_name FROM region
  UNION ALL SELECT array_to_string(w[1:3], ' '), 'organization', 'item-' || CAST(item_id AS VARCHAR) FROM bench WHERE len(w) >= 3
  UNION ALL SELECT array_to_string(w[1:2], ' '), 'organization', 'group-' || CAST(item_id % 7 AS VARCHAR) FROM bench WHERE len(w) >= 2),
senses AS (
  SELECT alias, CASE WHEN min(kind) = max(kind) THEN min(kind) END AS kind, CASE WHEN count(DISTINCT kind || '/' || value) = 1 THEN min(value) END AS value,
    len(string_split(alias, ' ')) AS size FROM aliases GROUP BY alias),
told AS (SELECT doc_id, text || ' Reports of an attack on ' || n_name || '.' AS body FROM documents JOIN nations ON n_nationkey = doc_id % 25),
cut AS (SELECT doc_id, body, regexp_extract_all(body, '[\p{L}\p{N}]+') AS raws, string_split_regex(body, '[\p{L}\p{N}]+') AS gaps FROM told),
words AS (
  SELECT doc_id, i, lower(raws[i]) AS w, sum(length(gaps[i])) OVER p + coalesce(sum(length(raws[i])) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    length(raws[i]) AS size FROM (SELECT doc_id, raws, gaps, unnest(range(1, len(raws) + 1)) AS i FROM cut) WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
grams AS (
  SELECT doc_id, i, start, unnest([w, w || ' ' || lead(w) OVER p, w || ' ' || lead(w) OVER p || ' ' || lead(w, 2) OVER p]) AS gram,
    unnest([start + size, lead(start + size) OVER p, lead(start + size, 2) OVER p]) AS stop FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
spelled AS (SELECT doc_id, i, start, stop, kind, value, s.size FROM grams g JOIN senses s ON g.gram = s.alias QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY s.size DESC) = 1),
chain AS (
  SELECT doc_id, arg_min(struct_pack(i, start, stop, kind, value, size), i) AS m FROM spelled GROUP BY doc_id
  UNION ALL
  SELECT c.doc_id, arg_min(struct_pack(s.i, s.start, s.stop, s.kind, s.value, s.size), s.i) FROM chain c JOIN spelled s ON s.doc_id = c.doc_id AND s.i >= c.m.i + c.m.size
  GROUP BY c.doc_id)
"""


def _alias_table(t):
    named = lambda rows: A.words_of(F.col(rows))
    bench = t["benchmark"].select("item_id", named("text").alias("w")).filter(F.size("w") >= 2)
    first = lambda k: F.array_join(F.slice("w", 1, k), " ").alias("alias")
    organization = F.lit("organization").alias("kind")
    items = bench.filter(F.size("w") >= 3).select(first(3), organization, F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("value"))
    groups = bench.select(first(2), organization, F.concat(F.lit("group-"), (F.col("item_id") % 7).cast("string")).alias("value"))
    places = t["nation"].selectExpr("n_name AS alias", "'country' AS kind", "n_name AS value").union(t["region"].selectExpr("r_name", "'region'", "r_name"))
    return places.union(items).union(groups)


def _told(t):
    return t["documents"].join(t["nation"], F.expr("doc_id % 25 = n_nationkey")).selectExpr(
        "doc_id", "text || ' Reports of an attack on ' || n_name || '.' AS body", "source")


@query(
    "alias_mentions",
    """SELECT doc_id, m.kind AS kind, m.value AS value, substr(body, CAST(m.start + 1 AS BIGINT), CAST(m.stop - m.start AS BIGINT)) AS raw,
         CAST(m.start AS BIGINT) AS start, CAST(m.stop AS BIGINT) AS stop,
         CASE WHEN m.value IS NULL THEN 'uncertain' WHEN substr(body, 1, CAST(m.start AS BIGINT)) LIKE '%an attack on ' THEN 'affected' ELSE 'mentioned' END AS role
       FROM chain JOIN told USING (doc_id)""",
    ctes=("RECURSIVE " + _ALIASES.strip(),),
)
def alias_mentions(t):
    told = _told(t)
    found = A.alias_mentions(told, "doc_id", "body", _alias_table(t))
    roles = A.with_roles(found, told, "doc_id", "body", "summary", F.concat("source", F.lit(".example")))
    return roles.select("doc_id", "kind", "value", "raw", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"), "role")


# Reports with their subject entities: one CVE and one address each, and one address everybody shares.
# Report times are 40 minutes apart, so a 30-day window holds 1080 of them.
_SUBJECTS = """
facts AS (
  SELECT doc_id AS id, 1704067200000 + doc_id * 2400000 AS ts, source AS t, lang AS region FROM documents),
subjects AS (
  SELECT doc_id AS id, 1704067200000 + doc_id * 2400000 AS ts, 'cve' AS kind, 'CVE-2024-' || CAST(1000 + doc_id % 97 AS VARCHAR) AS value FROM documents
  UNION ALL SELECT doc_id, 1704067200000 + doc_id * 2400000, 'ip', '10.0.' || CAST(doc_id % 3 AS VARCHAR) || '.1' FROM documents
  UNION ALL SELECT doc_id, 1704067200000 + doc_id * 2400000, 'organization', 'org' || CAST(doc_id % 7 AS VARCHAR) FROM documents),
generic AS (SELECT kind, value FROM subjects GROUP BY ALL HAVING count(*) > 0.2 * (SELECT count(*) FROM documents)),
specific AS (SELECT s.*, row_number() OVER (PARTITION BY kind, value ORDER BY id) AS position FROM subjects s ANTI JOIN generic USING (kind, value)),
pairs AS (
  SELECT a.id, a.ts, b.id AS other_id, b.ts AS other_ts, a.kind, a.value FROM specific a JOIN specific b
    ON a.kind = b.kind AND a.value = b.value AND a.position - b.position BETWEEN 1 AND 200
    AND a.ts - b.ts <= CASE WHEN a.kind = 'cve' THEN 365 ELSE 30 END * CAST(86400000 AS BIGINT))
"""


def _subjects(t):
    rows = t["documents"].selectExpr(
        "doc_id AS id", "1704067200000 + doc_id * 2400000 AS ts", "doc_id AS ord", "source AS t", "lang AS region",
        """inline(array(
             struct('cve' AS kind, 'CVE-2024-' || CAST(1000 + doc_id % 97 AS STRING) AS value),
             struct('ip' AS kind, '10.0.' || CAST(doc_id % 3 AS STRING) || '.1' AS value),
             struct('organization' AS kind, 'org' || CAST(doc_id % 7 AS STRING) AS value)))""",
    )
    return R.specific_entities(rows, t["documents"].count())


def _pairs(t):
    return R.candidate_pairs(_subjects(t), replace(t.doc_span, column="ord"), carried=("t", "region"))


@query("entity_candidates", "SELECT id, other_id, kind, value FROM pairs", ctes=(_SUBJECTS,))
def entity_candidates(t):
    return _pairs(t).select("id", "other_id", "kind", "value")


_RANKED = """
strongest AS (
  SELECT id, other_id, max(other_ts) AS other_ts, max(CASE kind WHEN 'cve' THEN 60 WHEN 'ip' THEN 50 ELSE 35 END) AS base FROM pairs GROUP BY ALL),
nearest AS (SELECT * FROM strongest QUALIFY row_number() OVER (PARTITION BY id ORDER BY other_ts DESC, other_id) <= 200),
scored AS (
  SELECT p.id, p.other_id, p.other_ts, p.base + CASE WHEN a.t = b.t THEN 10 ELSE 0 END
      + CASE WHEN abs(a.ts - b.ts) <= 604800000 THEN 10 ELSE 0 END + CASE WHEN a.region = b.region THEN 5 ELSE 0 END AS score
  FROM nearest p
  JOIN facts a ON a.id = p.id JOIN facts b ON b.id = p.other_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other_ts DESC, other_id) AS rank FROM scored WHERE score >= 45)
"""


def _related(t):
    return R.rank_relations(_pairs(t))


@query(
    "related_events",
    "SELECT id, other_id, rank, score FROM ranked WHERE rank <= 5",
    ctes=(_SUBJECTS, _RANKED),
)
def related_events(t):
    return _related(t).select("id", "other_id", "rank", "score")


@query(
    "relation_metrics",
    """SELECT count(*) AS queries, CAST(sum(cards) AS BIGINT) AS returned, CAST(sum(hits) AS BIGINT) AS relevant,
         round(sum(hits) / sum(cards), 6) AS precision_returned, round(count(*) FILTER (WHERE cards > 0) / count(*), 6) AS coverage,
         round(count(*) FILTER (WHERE quality = 1 AND hits > 0) / count(*) FILTER (WHERE quality = 1), 6) AS eligible_coverage,
         round(sum(hits) / (3 * count(*)), 6) AS slot_precision
       FROM (SELECT l.doc_id, l.quality, count(r.id) AS cards, count(r.id) FILTER (WHERE o.toxic = 0) AS hits
             FROM labels l LEFT JOIN ranked r ON r.id = l.doc_id AND r.rank <= 3 LEFT JOIN labels o ON o.doc_id = r.other_id
             GROUP BY l.doc_id, l.quality)""",
    ctes=(_SUBJECTS, _RANKED),
)
def relation_metrics(t):
    """Labelled documents as queries; a returned document is relevant when labelled not toxic."""
    labels = t["labels"]
    good = labels.select(F.col("doc_id").alias("other_id"), (F.col("toxic") == 0).alias("relevant"))
    returned = _related(t).join(good, "other_id", "left").select(
        F.col("id").alias("query_id"), "rank", F.coalesce("relevant", F.lit(False)).alias("relevant")
    )
    queries = labels.select(F.col("doc_id").alias("query_id"), (F.col("quality") == 1).alias("has_target"))
    metrics = R.relation_metrics(returned, queries)
    rounded = ("precision_returned", "coverage", "eligible_coverage", "slot_precision")
    return metrics.select("queries", "returned", "relevant", *(F.round(c, 6).alias(c) for c in rounded))


@query(
    "topic_metrics",
    """SELECT topic, count(*) AS queries, CAST(sum(cards) AS BIGINT) AS returned, CAST(sum(hits) AS BIGINT) AS relevant,
         round(sum(hits) / sum(cards), 6) AS precision_returned, round(count(*) FILTER (WHERE cards > 0) / count(*), 6) AS coverage,
         round(sum(hits) / (3 * count(*)), 6) AS slot_precision, CAST(sum(reviewed) AS BIGINT) AS reviewed, CAST(sum(wrong) AS BIGINT) AS unsupported,
         round((sum(reviewed) - sum(wrong)) / sum(reviewed), 6) AS reason_correctness
       FROM (SELECT l.doc_id, coalesce(any_value(d.source), 'none') AS topic, count(r.id) AS cards, count(r.id) FILTER (WHERE o.toxic = 0) AS hits,
               count(o.quality) AS reviewed, count(*) FILTER (WHERE o.quality = 0) AS wrong
             FROM labels l JOIN documents d ON d.doc_id = l.doc_id LEFT JOIN ranked r ON r.id = l.doc_id AND r.rank <= 3 LEFT JOIN labels o ON o.doc_id = r.other_id
             GROUP BY l.doc_id)
       GROUP BY GROUPING SETS ((topic), ())""",
    ctes=(_SUBJECTS, _RANKED),
)
def topic_metrics(t):
    """Labelled documents as queries, their source as topic; quality labels stand for reviewed reasons."""
    labels = t["labels"]
    good = labels.select(F.col("doc_id").alias("other_id"), (F.col("toxic") == 0).alias("relevant"), (F.col("quality") == 1).alias("correct"))
    returned = _related(t).join(good, "other_id", "left").select(F.col("id").alias("query_id"), "rank", F.coalesce("relevant", F.lit(False)).alias("relevant"), "correct")
    queries = labels.join(t["documents"].select("doc_id", F.col("source").alias("topic")), "doc_id").select(
        F.col("doc_id").alias("query_id"), (F.col("quality") == 1).alias("has_target"), "topic")
    m = R.topic_metrics(returned, queries)
    rounded = ("precision_returned", "coverage", "slot_precision", "reason_correctness")
    return m.select("topic", "queries", "returned", "relevant", "reviewed", "unsupported", *(F.round(c, 6).alias(c) for c in rounded))


@query(
    "mention_metrics",
    f"""SELECT count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE labelled) AS labelled,
          count(*) FILTER (WHERE accepted AND labelled) AS correct,
          round(count(*) FILTER (WHERE accepted AND labelled) / count(*) FILTER (WHERE accepted), 6) AS precision,
          round(count(*) FILTER (WHERE accepted AND labelled) / count(*) FILTER (WHERE labelled), 6) AS recall
        FROM (SELECT doc_id, value, bool_or(a) AS accepted, bool_or(b) AS labelled FROM (
          SELECT DISTINCT doc_id, lower(raw) AS value, true AS a, false AS b FROM found WHERE {_KIND} = 'domain'
          UNION ALL SELECT doc_id, 'host' || CAST(doc_id % 41 AS VARCHAR) || '.co.uk', false, true FROM documents) GROUP BY ALL)""",
    ctes=(_BODY, _FOUND),
)
def mention_metrics(t):
    found = R.entity_mentions(_bodies(t), "doc_id", "body").filter(F.col("kind") == "domain")
    labelled = t["documents"].selectExpr("doc_id", "'host' || CAST(doc_id % 41 AS STRING) || '.co.uk' AS value")
    m = R.mention_metrics(found, labelled, ["doc_id", "value"])
    return m.select("accepted", "labelled", "correct", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(
    "leakage_split",
    """SELECT doc_id, CASE WHEN p < 60 THEN 'train' WHEN p < 80 THEN 'dev' ELSE 'test' END AS part FROM (
         SELECT doc_id, CAST('0x' || substr(sha1(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N} ]', '', 'g'))), 1, 8) AS BIGINT) % 100 AS p FROM documents)""",
)
def leakage_split(t):
    """Documents equal up to case and punctuation fall on the same side; letters of every script count."""
    cluster = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N} ]", ""))
    return t["documents"].select("doc_id", R.leakage_safe_split(cluster).alias("part"))


_NEAR = r"""
cut AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
runs AS (SELECT doc_id, md5(array_to_string(list_slice(w, i, i + 2), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM cut WHERE len(w) > 0)),
hashed AS (SELECT doc_id, CAST('0x' || substr(h, 1, 16) AS UBIGINT) AS h FROM runs),
votes AS (SELECT doc_id, i, sum(CASE WHEN (h >> i) % 2 = 1 THEN 1 ELSE -1 END) AS v FROM hashed, (SELECT unnest(range(64)) AS i) GROUP BY ALL),
marks AS (SELECT doc_id, CAST(sum(CASE WHEN v > 0 THEN CAST(1 AS HUGEINT) << CAST(i AS INT) ELSE 0 END) AS UBIGINT) AS f FROM votes GROUP BY doc_id),
edges AS (SELECT x.doc_id AS a, y.doc_id AS b FROM marks x, marks y WHERE x.doc_id <> y.doc_id AND bit_count(xor(x.f, y.f)) <= 3),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
clusters AS (SELECT a AS doc_id, min(b) AS cluster FROM reach GROUP BY a)
"""


@query(
    "near_duplicate_split",
    """SELECT doc_id, cluster, CASE WHEN p < 60 THEN 'train' WHEN p < 80 THEN 'dev' ELSE 'test' END AS part FROM (
         SELECT doc_id, cluster, CAST('0x' || substr(sha1(CAST(cluster AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS p FROM clusters)""",
    ctes=("RECURSIVE " + _NEAR.strip(),),
)
def near_duplicate_split(t):
    """Near-duplicates, and what is connected through them, fall on the same side."""
    clusters = N.near_clusters(t["documents"], "doc_id", "text")
    return clusters.select("doc_id", "cluster", R.leakage_safe_split(F.col("cluster").cast("string")).alias("part"))


@query(
    "timeline_entries",
    """SELECT user_id, entry, rank, total > 20 AS truncated FROM (
         SELECT user_id, event_id AS entry, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank,
                count(*) OVER (PARTITION BY user_id) AS total
         FROM (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ts FROM events)) WHERE rank <= 20""",
)
def timeline_entries(t):
    entries = t.stream_events.select("user_id", F.col("ts").alias("observed_at"), F.col("id").alias("entry_uid"))
    return R.timeline(entries, "user_id").select("user_id", F.col("entry_uid").alias("entry"), "rank", "truncated")


_CORRECTED = """
gone AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 19 = 0),
finals AS (
  SELECT c_custkey AS old_id, CASE WHEN (c_custkey + 1) % 4 = 2 AND c_custkey % 4 = 1 AND EXISTS (SELECT 1 FROM customer d WHERE d.c_custkey = c.c_custkey + 1)
    THEN c_custkey + 2 ELSE c_custkey + 1 END AS final_id FROM customer c WHERE c_custkey % 4 IN (1, 2))
"""


@query(
    "corrections_applied",
    """SELECT id, count(*) AS orders FROM (
         SELECT coalesce(f.final_id, o.o_custkey) AS id FROM orders o LEFT JOIN finals f ON f.old_id = o.o_custkey
         WHERE o.o_custkey NOT IN (SELECT id FROM gone)) WHERE id NOT IN (SELECT id FROM gone) GROUP BY id""",
    ctes=(_CORRECTED,),
)
def corrections_applied(t):
    """Customers as events: every 19th retracted, 4k+1 merged into 4k+2 and that into 4k+3; orders are their sources."""
    c = F.col("c_custkey")
    customers = t["customer"]
    merges = customers.filter((c % 4).isin(1, 2)).select(c.alias("old_id"), (c + 1).alias("new_id"))
    lineage = R.resolve_lineage(merges)
    events = customers.select(c.alias("id"))
    sources = t["orders"].select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"))
    _, moved = R.apply_corrections(events, sources, customers.filter(c % 19 == 0).select(c.alias("id")), lineage)
    return moved.groupBy("id").agg(F.count("*").alias("orders"))


# Customers as events, their orders as sources. Every 10th is split: urgent orders to one successor, the rest to another;
# the urgent successor of every 20th is merged into customer 1, a split of the rest of every 30th begins later; every 19th is retracted.
_SPLIT = """
gone AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 19 = 0),
routed AS (
  SELECT o_orderkey, CASE WHEN k % 10 <> 0 THEN k WHEN urgent AND k % 20 = 0 THEN 1 WHEN urgent THEN 1000000 + k ELSE 2000000 + k END AS id
  FROM (SELECT o_orderkey, o_custkey AS k, o_orderpriority = '1-URGENT' AS urgent FROM orders))
"""


def _split_lineage(t):
    c = F.col("c_custkey")
    row = lambda keep, new, part, begin: t["customer"].filter(keep).select(
        c.alias("old_id") if new is not None else (c + 1_000_000).alias("old_id"), (F.lit(1) if new is None else c + new).cast("long").alias("new_id"),
        F.lit(part).cast("string").alias("part"), F.lit(begin).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
    rows = row(c % 10 == 0, 1_000_000, "1-URGENT", None).union(row(c % 10 == 0, 2_000_000, None, 5)).union(row(c % 20 == 0, None, None, 7))
    later = t["customer"].filter(c % 30 == 0).select((c + 2_000_000).alias("old_id"), (c + 3_000_000).alias("new_id"), F.lit(None).cast("string").alias("part"),
                                                     F.lit(100).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
    return R.active(rows.union(later), 50)


@query(
    "split_lineage",
    "SELECT id, count(*) AS orders FROM routed WHERE id NOT IN (SELECT id FROM gone) GROUP BY id",
    ctes=(_SPLIT,),
)
def split_lineage(t):
    sources = t["orders"].select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("part"), "o_orderkey")
    routed = R.route_sources(sources, _split_lineage(t))
    gone = t["customer"].filter("c_custkey % 19 = 0").select(F.col("c_custkey").alias("id"))
    return routed.join(gone, "id", "left_anti").groupBy("id").agg(F.count("*").alias("orders"))


@query(
    "stale_after_split",
    """SELECT DISTINCT o_custkey AS left_id, o_orderkey % 50 AS right_id FROM orders WHERE o_custkey % 10 = 0 OR o_custkey % 19 = 0 OR o_custkey = 1""",
)
def stale_after_split(t):
    """Edges of events that a split, merge or retraction touches, on any level."""
    edges = t["orders"].select(F.col("o_custkey").alias("left_id"), (F.col("o_orderkey") % 50).alias("right_id")).distinct()
    tombstones = t["customer"].filter("c_custkey % 19 = 0").select(F.col("c_custkey").alias("id"))
    touched = R.touched_by(_split_lineage(t), tombstones)
    shifted = edges.withColumn("right_id", -F.col("right_id") - 1)  # the other side is of another kind
    return R.stale_edges(shifted, touched).select("left_id", (-F.col("right_id") - 1).alias("right_id"))


@query(
    "stale_edges",
    """SELECT l_partkey, l_suppkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
       WHERE l_partkey % 50 = 0 OR l_suppkey % 40 = 0""",
)
def stale_edges(t):
    """Part-supplier edges touched by corrected parts or suppliers."""
    edges = durable(t["lineitem"].select(F.col("l_partkey").alias("left_id"), (-F.col("l_suppkey")).alias("right_id")).distinct())
    parts = edges.filter(F.col("left_id") % 50 == 0).select(F.col("left_id").alias("id"))
    suppliers = edges.filter(F.col("right_id") % 40 == 0).select(F.col("right_id").alias("id"))
    stale = R.stale_edges(edges, parts.unionByName(suppliers))
    return stale.select(F.col("left_id").alias("l_partkey"), (-F.col("right_id")).alias("l_suppkey"))


