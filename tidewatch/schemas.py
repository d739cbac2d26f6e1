"""Column lists of the stored tables and of the nested published documents."""

ARTICLES = (
    "seq bigint, title string, url string, domain string, language string, tone string, seendate string, "
    "location struct<fullName:string,countryCode:string>, lat string, `long` string, rss_topic string, rss_source string, "
    "rss_description string, media_image string, video_url string, socialimage string"
)

EVENT_FIELDS = (
    "id bigint, seq bigint, t string, sev string, title string, summary string, src string, loc string, lat double, lon double, "
    "ts bigint, ingested_at bigint, tone double, quality int, geo_tier string, geo_source string, geo_policy string, "
    "geo_scope string, geo_evidence string, date_defaulted boolean, articles bigint, n_sources bigint, n_outlets bigint, "
    "confidence int, pulse boolean, image string, video_url string, set_x bigint, set_y bigint"
)

# Every table is partitioned by the publication sequence that wrote it.
TABLES = {
    "judged": "seq bigint, t string, sev string, title string, summary string, src string, loc string, lat double, lon double, "
    "ts bigint, ingested_at bigint, url string, tone double, quality int, geo_tier string, geo_source string, geo_policy string, "
    "geo_scope string, geo_evidence string, media_image string, video_url string, date_defaulted boolean, outcome string",
    "events": EVENT_FIELDS,
    "event_sources": "id bigint, origin bigint, seq bigint, url string",
    # What the fold looks up by key: see plans/state.py.
    "url_index": "id bigint, origin bigint, seq bigint, url string",
    "story_index": "story_key string, id bigint, live_rank bigint",
    "outlet_index": "id bigint, host string",
    "live": "id bigint, confidence int, pulse boolean",
    "source_records": "source_uid string, provider string, natural_key string, original_url string, canonical_url string",
    "source_revisions": "revision_uid string, source_uid string, content_hash string, published_at bigint, observed_at bigint, "
    "title string, summary string, canonical_url string",
    "source_observations": "run_uid string, source_uid string, revision_uid string, normalization_outcome string, observed_at bigint",
    "event_revisions": "event_uid string, id bigint, t string, sev string, title string, summary string, src string, loc string, "
    "lat double, lon double, ts bigint, n_sources bigint, semantic_hash string, revision_uid string, created_at bigint, origin string",
    "event_evidence": "event_revision_uid string, source_revision_uid string",
    "event_mapping": "id bigint, event_uid string, import_identity string",
    "source_health": "run_uid string, provider string, state string, error_code string",
    "runs": "run_uid string, entry int, logged_at bigint, outcome string, accepted bigint, rejected bigint, last_success bigint",
    "gaps": "run_uid string, reason string, seen_at bigint",
    "manifests": "last_sync bigint, last_attempt bigint, next_event_id bigint, state_sequence bigint, health string, "
    "failed_sources array<string>, ingested bigint, deduped bigint, merged bigint, rejected bigint, events bigint, "
    "topic_cyber bigint, topic_geopolitical bigint, topic_maritime bigint, topic_military bigint, severity_critical bigint, "
    "severity_escalating bigint, severity_watching bigint, severity_deesc bigint, pulse bigint, base_generation bigint, base_buckets int, "
    "history_sequence bigint",
    "layer_pointers": "name string, stamp bigint, objects bigint",
    "publications": "publication_uid string, state string, payload_hash string, logged_at bigint",
}

# One published event document. Events with very many sources span several parts.
DOCUMENT = (
    "id bigint, part bigint, t string, sev string, title string, summary string, src string, loc string, lat double, lon double, "
    "ts bigint, ingestedAt bigint, sources array<string>, "
    "score struct<articles:bigint,tone:double,quality:int,confidence:int>, "
    "media struct<image:string,video_url:string>, geo struct<tier:string,source:string,policy:string,scope:string,evidence:string>"
)
