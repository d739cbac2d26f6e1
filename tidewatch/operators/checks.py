"""Contract and integrity checks that report every broken rule instead of stopping at the first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import vocabulary as V

MAX_ID = 9_007_199_254_740_991
MAX_MS = 8_640_000_000_000_000
MAX_DETAIL_BYTES = 150 * 1024
UID_PATTERN = r"^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
EVENT_FIELDS = frozenset(
    "id t sev title summary src loc lat lon ts ingestedAt sources score media geo".split()
)


def broken_rules(rules: dict[str, Column]) -> Column:
    """Array of the names whose condition holds; a null condition does not count."""
    return F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())))


def _outside(value: Column, low, high) -> Column:
    """Missing, not a number, or out of range."""
    return value.isNull() | F.isnan(value.cast("double")) | ~value.between(low, high)


def event_violations() -> Column:
    """Rules of the event contract over the flat event columns."""

    def outside(column: str, low, high) -> str:
        return f"{column} IS NULL OR isnan(CAST({column} AS DOUBLE)) OR NOT {column} BETWEEN {low} AND {high}"

    topics, severities = (", ".join(f"'{x}'" for x in names) for names in (V.TOPICS, V.SEVERITIES))
    rules = {
        "topic": f"t IS NULL OR t NOT IN ({topics})",
        "severity": f"sev IS NULL OR sev NOT IN ({severities})",
        "title_length": "title IS NULL OR NOT length(title) BETWEEN 10 AND 200",
        "summary_length": "length(summary) > 1000",
        "source_label": "src IS NULL",
        "place_label": "loc IS NULL",
        "latitude": outside("lat", -90, 90),
        "longitude": outside("lon", -180, 180),
        "time": outside("ts", 0, MAX_MS),
        "url": r"url IS NULL OR NOT url rlike r'^https?://[^\s]+$'",
        "tone": outside("tone", -100, 100),
        "quality": "NOT quality BETWEEN 0 AND 100",
    }
    cases = ", ".join(f"CASE WHEN {bad} THEN '{name}' END" for name, bad in rules.items())
    return F.expr(f"array_compact(array({cases}))")


def document_violations(payload: str = "payload") -> Column:
    """Event contract over a JSON document column, unknown top-level fields included."""
    doc = F.col(payload)

    def text(path: str) -> Column:
        return F.get_json_object(doc, f"$.{path}")

    keys = F.json_object_keys(doc)
    unknown = F.exists(keys, lambda k: ~k.isin(*sorted(EVENT_FIELDS)))
    number = {p: text(p).try_cast("double") for p in ("id", "lat", "lon", "ts", "score.tone", "score.articles")}
    whole = {p: text(p).rlike(r"^-?\d+$") for p in ("id", "ts", "score.articles")}
    return broken_rules(
        {
            "not_an_object": keys.isNull(),
            "unknown_field": unknown,
            "id": text("id").isNull() | ~whole["id"] | _outside(number["id"], 1, MAX_ID),
            "t": text("t").isNull() | ~text("t").isin(*V.TOPICS),
            "sev": text("sev").isNull() | ~text("sev").isin(*V.SEVERITIES),
            "title": text("title").isNull() | ~F.length(text("title")).between(10, 200),
            "summary": F.length(text("summary")) > 1000,
            "src": text("src").isNull(),
            "loc": text("loc").isNull(),
            "lat": _outside(number["lat"], -90, 90),
            "lon": _outside(number["lon"], -180, 180),
            "ts": ~F.coalesce(whole["ts"], F.lit(False)) | _outside(number["ts"], 0, MAX_MS),
            "sources": (F.coalesce(F.json_array_length(text("sources")), F.lit(0)) < 1)
            | F.exists(
                F.from_json(text("sources"), "array<string>"), lambda u: ~u.rlike(r"^https?://[^\s]+$")
            ),
            "score": text("score").isNull()
            | ~F.coalesce(whole["score.articles"], F.lit(False))
            | (number["score.articles"] < 1)
            | _outside(number["score.tone"], -100, 100),
            "media_image": ~text("media.image").rlike(V.IMAGE_PATH_PATTERN),
            "media_video": ~text("media.video_url").rlike(V.VIDEO_LINK_PATTERN),
            "geo": text("geo").isNotNull()
            & (
                ~F.coalesce(text("geo.tier").isin("precise", "approximate"), F.lit(False))
                | ~F.coalesce(text("geo.source").isin("source", "nominatim", "title", "summary"), F.lit(False))
            ),
        }
    )


def snapshot_consistency(events: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row of checks of an event table against its one-row manifest."""
    actual = events.agg(
        F.count("*").alias("n"),
        F.countDistinct("id").alias("ids"),
        F.coalesce(F.max("id"), F.lit(0)).alias("max_id"),
        *(F.count_if(F.col("t") == t).alias(f"n_{t}") for t in V.TOPICS),
        *(F.count_if(F.col("sev") == s).alias(f"n_{s}") for s in V.SEVERITIES),
    )
    both = actual.withColumn("one", F.lit(1)).join(manifest.withColumn("one", F.lit(1)), "one")

    def same(prefix: str, names) -> Column:
        return reduce(
            Column.__and__,
            (F.col(f"n_{x}") == F.coalesce(F.col(f"{prefix}_{x}"), F.lit(0)) for x in names),
        )

    return both.select(
        (F.col("n") == F.col("ids")).alias("ids_unique"),
        (F.col("n") == F.col("events")).alias("count_matches"),
        same("topic", V.TOPICS).alias("topics_match"),
        same("severity", V.SEVERITIES).alias("severities_match"),
        (F.coalesce(F.col("next_event_id"), F.col("max_id") + 1) > F.col("max_id")).alias("next_id_free"),
    )


def index_violations(entries: DataFrame) -> DataFrame:
    """Rows (release_uid, event_id, rule) for index entries that break a rule.

    Expects ``release_uid, event_id, event_uid, artifact_path``. Repeats are found
    by counting ids, so a hot id costs no more than its partial counts.
    """
    prefix = "/data/intelligence/v1/releases/"
    path = F.col("artifact_path")
    expected = F.concat(
        F.lit(prefix), F.col("release_uid"), F.lit("/events/"), F.col("event_uid"), F.lit(".json")
    )
    rules = broken_rules(
        {
            "path_outside": ~path.startswith(prefix),
            "path_unsafe": path.rlike(r"(^|/)\.{1,2}(/|$)|[?#]"),
            "path_mismatch": path != expected,
        }
    )
    structural = entries.select("release_uid", "event_id", F.explode(rules).alias("rule"))

    def repeated(column: str, rule: str) -> DataFrame:
        return (
            entries.groupBy("release_uid", column)
            .agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))
            .filter("n > 1")
            .select("release_uid", F.col("first_id").alias("event_id"), F.lit(rule).alias("rule"))
        )

    return (
        structural.unionByName(repeated("event_id", "duplicate_event_id"))
        .unionByName(repeated("event_uid", "duplicate_event_uid"))
    )


# Bounds of the arrays in one detail artifact.
ARRAY_BOUNDS = {"evidence": 20, "entities": 20, "timeline": 20, "related": 5}
MAX_MENTIONS = 5


def _uids(array: Column, field: str) -> Column:
    return F.transform(array, lambda x: x[field])


def _any_missing(refs: Column, known: Column) -> Column:
    return F.size(F.array_except(refs, known)) > 0


def detail_violations() -> Column:
    """Cross-object rules of one detail artifact, over its nested columns.

    The arrays are bounded by contract, so each artifact is judged inside its
    own row: no explode, no join, no shuffle.
    """
    c = F.col
    evidence, entities, timeline, related = c("evidence"), c("entities"), c("timeline"), c("related")
    known = _uids(evidence, "evidenceUid")
    entity_uids = _uids(entities, "entityUid")
    mentions = F.flatten(_uids(entities, "mentions"))
    reasons = F.flatten(_uids(related, "reasons"))

    def repeated(array: Column, field: str) -> Column:
        return F.size(F.array_distinct(_uids(array, field))) < F.size(array)

    def paired(m: Column) -> Column:
        return m.start.isNull() != m.end.isNull()

    empty_excerpt = lambda e: F.coalesce(e.excerpt, F.lit("")) == ""
    rules = {
        "duplicate_evidence": repeated(evidence, "evidenceUid"),
        "duplicate_entity": repeated(entities, "entityUid"),
        "duplicate_timeline": repeated(timeline, "entryUid"),
        "origin_missing": _any_missing(
            F.array_compact(_uids(evidence, "reportingOriginUid")), known
        ),
        "mention_evidence_missing": _any_missing(_uids(mentions, "evidenceUid"), known),
        "offset_unpaired": F.exists(mentions, paired),
        "offset_invalid": F.exists(
            mentions, lambda m: m.start.isNotNull() & m.end.isNotNull() & ~((m.start >= 0) & (m.start < m.end))
        ),
        "timeline_evidence_missing": _any_missing(F.flatten(_uids(timeline, "evidenceUids")), known),
        "reason_entity_missing": _any_missing(_uids(reasons, "entityUid"), entity_uids),
        "reason_evidence_missing": _any_missing(F.flatten(_uids(reasons, "evidenceUids")), known),
        "related_self": F.exists(related, lambda r: r.target.eventUid == c("eventUid")),
        "source_text_empty": F.exists(
            evidence, lambda e: (e.evidenceKind == "source_text") & empty_excerpt(e)
        ),
        "metadata_with_excerpt": F.exists(
            evidence, lambda e: (e.evidenceKind == "metadata_only") & e.excerpt.isNotNull()
        ),
        "removed_with_excerpt": F.exists(
            evidence, lambda e: (e.status == "removed") & ~empty_excerpt(e)
        ),
        "mentions_bound": F.exists(entities, lambda e: F.size(e.mentions) > MAX_MENTIONS),
    }
    rules |= {f"{name}_bound": F.size(c(name)) > n for name, n in ARRAY_BOUNDS.items()}
    return broken_rules(rules)


def oversized(payload: Column) -> Column:
    """Complete detail documents are limited in bytes, not characters."""
    return F.octet_length(payload) > MAX_DETAIL_BYTES


def detail_mismatch(details: DataFrame, index: DataFrame) -> DataFrame:
    """Rows (eventUid, field) where an artifact disagrees with the index entry for its event."""
    fields = ("releaseUid", "eventRevisionUid", "projectionHash")
    joined = details.alias("d").join(index.alias("i"), F.col("d.eventUid") == F.col("i.eventUid"), "left")
    wrong = broken_rules(
        {
            "eventUid": F.col("i.eventUid").isNull(),
            **{f: F.col(f"d.{f}") != F.col(f"i.{f}") for f in fields},
        }
    )
    return joined.select(F.col("d.eventUid").alias("eventUid"), F.explode(wrong).alias("field"))


def dangling(children: DataFrame, parents: DataFrame, scope: str, ref: str, key: str) -> DataFrame:
    """Child rows whose reference has no parent in the same artifact."""
    known = parents.select(F.col(scope), F.col(key).alias(ref)).distinct()
    return children.join(known, [scope, ref], "left_anti")


def payload_mismatches(jobs: DataFrame) -> DataFrame:
    """Stored publication payloads whose recomputed hash differs from the recorded one."""
    return jobs.filter(F.sha2(F.col("payload"), 256) != F.col("payload_hash"))
