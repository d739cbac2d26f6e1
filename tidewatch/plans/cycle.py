"""One ingestion cycle: articles in, a new published sequence out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import vocabulary as V
from tidewatch.functions.places_text import Gazetteer
from tidewatch.operators import corroborate, history, views
from tidewatch.operators.audit import geo_violations
from tidewatch.operators.normalize import accepted, normalize, story_key
from tidewatch.operators.numbering import OrderSpan
from tidewatch.plans.state import FoldState, added_totals, live_rank, with_added
from tidewatch.plans.warehouse import Warehouse, columns_of, table_digest
from tidewatch.session import durable
from tidewatch.sources.records import with_provider


class UnsafeLocations(RuntimeError):
    """Stored events carry coordinates their text does not support; run the re-audit first."""


class BootstrapRequired(RuntimeError):
    """Archive mode needs a published or imported state to continue from."""


@dataclass(frozen=True)
class Batch:
    """What one fetch brought: articles in the common shape, and how the sources fared."""

    articles: DataFrame
    succeeded: int = 1
    failed: Sequence[str] = field(default_factory=tuple)
    second_provider: bool = False


@dataclass(frozen=True)
class Policy:
    mode: str = "archive"  # legacy: no history; shadow: history may fail; archive: history is required
    live_limit: int = V.LIVE_EVENTS
    gazetteer: Gazetteer | None = None
    #: Sequences after which the deltas are merged into a new base, and its buckets (None: by the number of URLs).
    compact_after: int = 96
    buckets: int | None = None


#: Columns of a manifest that say how its state is read.
STATE_POINTERS = ("base_generation", "base_buckets", "history_sequence")
PROVIDER_LABELS = {"RSS": "rss", "GDELT": "gdelt"}


def run_cycle(spark: SparkSession, root: str, batch: Batch, as_of_ms: int, policy: Policy | None = None,
              token: str | None = None) -> dict:
    """Fold one batch into the state under ``root`` and publish the result; returns the manifest row.

    The state is looked up by the keys of the batch, and what the batch adds or changes is written once and read
    back, facts before the pointer. Only one-row summaries and bucket numbers come to the driver. ``token`` names the batch: a batch whose
    token is already published is not folded again.
    """
    policy = policy or Policy()
    if policy.mode not in ("legacy", "shadow", "archive"):
        raise ValueError(f"unknown mode: {policy.mode}")
    house = Warehouse(spark, root)
    if token is not None:
        before = house.read("publications").filter(F.col("publication_uid") == token).select("sequence").first()
        if before is not None:
            return {"sequence": before["sequence"], "repeated": True}
    sequence = house.committed() + 1
    uid = token or f"publication-{sequence:012d}"
    manifest = current_manifest(house)
    state = FoldState.of(house, manifest)
    prior = live_rows(state)
    refuse_unsafe(prior, policy.gazetteer)
    if batch.succeeded == 0:
        return _retain(house, manifest, sequence, uid, batch, as_of_ms, policy)

    judged = house.write("judged", normalize(batch.articles, as_of_ms, policy.gazetteer), sequence)
    next_id = max(manifest.get("next_event_id") or 1, 1)
    fold = fold_batch(house, state, judged, batch.articles, sequence, next_id, as_of_ms)
    after = FoldState(house, sequence, state.base)
    created_ids = fold.new_events.agg(F.max("id").alias("top"), F.count("*").alias("created")).first()
    tallies = judged.agg(
        F.count("*").alias("ingested"),
        F.count_if(F.col("outcome") == "accepted").alias("accepted"),
        F.count_if(F.col("outcome").startswith("rejected:")).alias("rejected"),
    ).first()
    n_fresh = fold.new_sources.count()
    failed = [*batch.failed, *(["Invalid source records"] if tallies["rejected"] else [])]
    run_uid, recorded = f"run-{sequence:012d}", manifest.get("history_sequence") or 0
    if policy.mode != "legacy":
        try:
            record_history(house, sequence, run_uid, batch, judged, state, after, recorded, as_of_ms)
            recorded = sequence
        except Exception as error:
            if policy.mode == "archive":
                raise
            house.append("gaps", house.row("gaps", run_uid=run_uid, reason=type(error).__name__, seen_at=as_of_ms), sequence)

    live = write_live(house, after, prior, manifest, policy.live_limit, as_of_ms)
    counts = views.manifest_counts(live).first().asDict()
    base = state.base
    if sequence - base.generation >= policy.compact_after:
        base = after.compact(policy.buckets)
    row = {
        **counts, "last_sync": as_of_ms, "last_attempt": as_of_ms, "state_sequence": sequence,
        "next_event_id": max(next_id, (created_ids["top"] or 0) + 1), "health": "degraded" if failed else "ok",
        "failed_sources": failed, "ingested": tallies["ingested"], "deduped": tallies["accepted"] - n_fresh,
        "merged": n_fresh - created_ids["created"], "rejected": tallies["rejected"],
        "base_generation": base.generation, "base_buckets": base.buckets, "history_sequence": recorded,
    }
    return commit(
        house, sequence, uid, row, live, as_of_ms, accepted_n=tallies["accepted"],
        rejected_n=tallies["ingested"] - tallies["accepted"], gazetteer=policy.gazetteer,
    )


@dataclass(frozen=True)
class Fold:
    """What a batch added: written rows of its sequence."""

    new_events: DataFrame
    new_sources: DataFrame


def fold_batch(house: Warehouse, state: FoldState, judged: DataFrame, articles: DataFrame, sequence: int, next_id: int,
               as_of_ms: int) -> Fold:
    """Fold a judged batch into the state: reads the keys of the batch, writes what it adds or changes."""
    reports = accepted(judged)
    known = state.urls.lookup(reports.select("url").union(articles.select("url")))
    fresh = durable(story_key(corroborate.unseen_urls(reports, known)))
    stories = state.stories.lookup(fresh).select("story_key", "id")
    merge = corroborate.attach(fresh, stories, OrderSpan.of(judged, "seq"), next_id)
    new_sources = house.write("event_sources", merge.new_sources.withColumn("origin", F.lit(sequence).cast("long")), sequence)
    house.write("url_index", new_sources, sequence)
    hosts = corroborate.outlets(new_sources).select("id", "host")
    new_hosts = house.write("outlet_index", hosts.join(state.outlets.lookup(hosts), ["id", "host"], "left_anti"), sequence)

    created = durable(merge.new_events.withColumnRenamed("media_image", "image_hint").withColumnRenamed("video_url", "video_hint"))
    nothing = {"image": "string", "video_url": "string", **dict.fromkeys(("articles", "n_sources", "n_outlets", "set_x", "set_y"), "long")}
    opened = created.withColumns({name: F.lit(None).cast(kind) for name, kind in nothing.items()})
    hints = media_of(articles)
    cited = known.drop("sequence").unionByName(new_sources)
    touched = new_sources.select("id").union(cited.join(hints, "url", "left_semi").select("id"))
    columns = [c for c in columns_of("events") if c not in ("confidence", "pulse")]
    events = state.events.lookup(touched).select(*columns).unionByName(opened.select(*columns))
    media = corroborate.media_hints(cited, hints, events.select("id", "image", "video_url"))
    counted = with_added(events.drop("image", "video_url").join(media, "id"), added_totals(new_sources, new_hosts))
    house.write("events", corroborate.rescored(counted, as_of_ms), sequence)
    house.write("story_index", created.withColumn("live_rank", live_rank()).select("story_key", "id", "live_rank"), sequence)
    return Fold(created, new_sources)


def current_manifest(house: Warehouse) -> dict:
    """Newest manifest with the defaults of a state written before a field existed."""
    last = house.committed()
    found = house.read("manifests", last).limit(1).first() if last else None
    return found.asDict() if found else {"last_sync": 0, "last_attempt": 0, "next_event_id": 1, "state_sequence": 0}


def live_rows(state: FoldState) -> DataFrame:
    """The events that a sequence shows, with the scores it showed: its list of ids, looked up."""
    shown = state.house.load("live", columns_of("live")).filter(F.col("sequence") == state.at).drop("sequence")
    found = state.events.lookup(shown).drop("confidence", "pulse", "sequence")
    return found.join(shown, "id").select(*columns_of("events"))


def write_live(house: Warehouse, state: FoldState, prior: DataFrame, manifest: dict, limit: int, as_of_ms: int) -> DataFrame:
    """The newest events among those shown before and those just written, scored at ``as_of``; written as ids and scores.

    An event that fell behind the limit comes back only when it changes, since the order is that of ingestion. A limit that grew
    is filled from the whole state.
    """
    written = state.events.read() if (manifest.get("events") or 0) < limit and state.at > 1 else None
    if written is None:
        fresh = state.events.changed_since(state.at - 1)
        written = prior.drop("confidence", "pulse").join(fresh.select("id"), "id", "left_anti").unionByName(fresh.drop("sequence", "confidence", "pulse"))
    live = corroborate.rescored(views.live_events(written.drop("sequence", "confidence", "pulse"), limit), as_of_ms)
    house.write("live", live, state.at)
    return live_rows(state)


def full_state(house: Warehouse, manifest: dict) -> tuple[DataFrame, DataFrame]:
    """All events of the newest state and all their sources."""
    state = FoldState.of(house, manifest)
    return state.events.read().drop("sequence"), state.event_sources.read().drop("sequence")


def current_state(house: Warehouse, manifest: dict, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Live events of the newest state and the sources of exactly those events."""
    state = FoldState.of(house, manifest)
    live = views.live_events(live_rows(state), limit or manifest.get("events") or V.LIVE_EVENTS)
    return live, state.event_sources.lookup(live).drop("sequence")


def refuse_unsafe(events: DataFrame, gazetteer: Gazetteer | None = None) -> None:
    """Fail closed: no cycle starts from, and none publishes, an unsupported location."""
    first = geo_violations(events, gazetteer).select("id").limit(1).first()
    if first is not None:
        raise UnsafeLocations(f"event {first['id']}")


def media_of(articles: DataFrame) -> DataFrame:
    """Image and video that a batch offers by URL; the last hint of a URL counts."""
    return (
        articles.filter("coalesce(media_image, '') <> '' OR coalesce(video_url, '') <> ''")
        .groupBy("url").agg(F.max(F.struct("seq", "media_image", "video_url")).alias("h"))
        .select("url", F.col("h.media_image").alias("image"),
                F.when(F.col("h.video_url").rlike(V.VIDEO_LINK_PATTERN), F.col("h.video_url")).alias("video_url"))
    )


def record_history(house: Warehouse, sequence: int, run_uid: str, batch: Batch, judged: DataFrame, before: FoldState,
                   after: FoldState, recorded: int, as_of_ms: int) -> None:
    """Append this run's sources, revisions, observations, event revisions, evidence and health.

    Event revisions are taken of what changed since the last recorded sequence; what history holds is looked up by key.
    """
    providers = with_provider(batch.articles, batch.second_provider).filter("provider IS NOT NULL").select(
        "seq", "provider", "url", "title", F.col("rss_description").alias("summary"), "seendate"
    )
    seen = durable(history.observe(providers.join(judged.select("seq", "outcome"), "seq")))
    usable = seen.filter("natural_key IS NOT NULL")
    house.write("source_records", history.new_sources(seen, before.source_keys.lookup(usable)), sequence)
    house.write("source_revisions", history.new_source_revisions(seen, as_of_ms, before.revision_keys.lookup(usable)), sequence)
    house.write("source_observations", history.new_observations(seen, run_uid, as_of_ms), sequence)
    changed = after.events.changed_since(recorded).drop("sequence")
    semantic = durable(history.semantic_rows(changed.withColumn("set_n", F.nullif("articles", F.lit(0)))))
    revisions = house.write(
        "event_revisions", history.new_event_revisions(semantic, as_of_ms, before.event_revision_keys.lookup(semantic)), sequence
    )
    cited = after.urls.lookup(seen.select(F.trim("url").alias("url")))
    house.write("event_evidence", history.new_evidence(revisions, cited, seen), sequence)
    failed = [PROVIDER_LABELS[f.upper()] for f in batch.failed if f.upper() in PROVIDER_LABELS]
    enabled = ["rss", *(["gdelt"] if batch.second_provider else [])]
    house.write("source_health", history.source_health(seen, run_uid, failed, enabled), sequence)


def _retain(house: Warehouse, manifest: dict, sequence: int, uid: str, batch: Batch, as_of_ms: int, policy: Policy) -> dict:
    """Nothing could be fetched: keep the events, move the attempt clock, report the error."""
    events, _ = current_state(house, manifest)
    row = {
        **views.manifest_counts(events).first().asDict(), "last_sync": manifest["last_sync"], "last_attempt": as_of_ms,
        "state_sequence": manifest["state_sequence"], "next_event_id": manifest["next_event_id"], "health": "error",
        "failed_sources": list(batch.failed), "ingested": 0, "deduped": 0, "merged": 0, "rejected": 0,
        **{name: manifest.get(name) for name in STATE_POINTERS},
    }
    return commit(house, sequence, uid, row, events, as_of_ms, gazetteer=policy.gazetteer)


def commit(house: Warehouse, sequence: int, uid: str, row: dict, live: DataFrame, as_of_ms: int, *, accepted_n: int = 0,
           rejected_n: int = 0, gazetteer: Gazetteer | None = None) -> dict:
    """Check once more, write the manifest and ledger, and add the pointer last."""
    refuse_unsafe(live, gazetteer)
    house.write("manifests", house.row("manifests", **row), sequence)
    outcome = row["health"]
    house.write("runs", house.row(
        "runs", run_uid=f"run-{sequence:012d}", entry=1, logged_at=as_of_ms, outcome=outcome, accepted=accepted_n,
        rejected=rejected_n, last_success=None if outcome == "error" else row["last_sync"],
    ), sequence)
    digest = live.agg(table_digest(live)).first()[0]
    house.write("publications", house.row(
        "publications", publication_uid=uid, state="pending", payload_hash=digest, logged_at=as_of_ms
    ), sequence)
    return {"sequence": sequence, **row}
