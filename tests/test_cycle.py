"""End-to-end cycles: merging, retention, health, identities, history, crash safety."""

import pytest
from pyspark.sql import functions as F
from tests.helpers import AS_OF, article, batch

from tidewatch.plans.cycle import Batch, Policy, UnsafeLocations, current_manifest, current_state, run_cycle
from tidewatch.plans.publication import (
    BootstrapRequired, PayloadHashMismatch, documents, import_state, mirror_path, pending, repair_mirrors, replay, require_bootstrap,
)
from tidewatch.plans.reaudit import reaudit
from tidewatch.plans.warehouse import Warehouse

HEADLINE = "Ransomware crew claims hospital systems"
PLAIN, ARCHIVE = Policy(mode="legacy"), Policy(mode="archive")
A = article(1, HEADLINE, "https://one.example/a")
B = article(2, HEADLINE + "!", "https://www.two.example/b")
A_AGAIN = article(3, "Ransomware crew renamed story", "https://one.example/a")


def cycle(spark, root, *rows, as_of=AS_OF, policy=None, **kw):
    return run_cycle(spark, root, Batch(batch(spark, *rows), **kw), as_of, policy or PLAIN)


def test_two_outlets_merge_and_a_repeat_is_dropped(spark, folder):
    row = cycle(spark, folder, A, B, A_AGAIN)
    assert (row["events"], row["merged"], row["deduped"], row["ingested"]) == (1, 1, 1, 3)
    events, sources = current_state(Warehouse(spark, folder), row)
    event = events.first()
    assert event["title"] == HEADLINE and event["articles"] == 2 and event["n_outlets"] == 2 and event["pulse"]
    assert [r["url"] for r in sources.orderBy("seq").collect()] == ["https://one.example/a", "https://www.two.example/b"]


def test_known_url_with_new_title_stays_one_event(spark, folder):
    cycle(spark, folder, A)
    row = cycle(spark, folder, article(1, "Ransomware crew releases hospital files", "https://one.example/a"), as_of=AS_OF + 1000)
    assert (row["events"], row["deduped"], row["merged"]) == (1, 1, 0)


def test_later_outlet_joins_the_stored_event(spark, folder):
    first = cycle(spark, folder, A)
    row = cycle(spark, folder, B, as_of=AS_OF + 1000)
    assert row["merged"] == 1 and row["events"] == 1 and row["next_event_id"] == first["next_event_id"]


def test_total_failure_keeps_events_and_success_clock(spark, folder):
    good = cycle(spark, folder, A)
    bad = cycle(spark, folder, as_of=AS_OF + 5000, succeeded=0, failed=["RSS"])
    assert bad["health"] == "error" and bad["events"] == 1
    assert bad["last_sync"] == good["last_sync"] and bad["last_attempt"] == AS_OF + 5000
    after = cycle(spark, folder, B, as_of=AS_OF + 9000)
    assert after["merged"] == 1 and after["health"] == "ok"


def test_partial_failure_degrades_and_empty_success_does_not(spark, folder):
    assert cycle(spark, folder, A, failed=["BBC World"])["health"] == "degraded"
    assert cycle(spark, folder, as_of=AS_OF + 1)["health"] == "ok"


def test_rejected_rows_degrade_and_are_never_published(spark, folder):
    row = cycle(spark, folder, A, article(2, "Ransomware hits unnamed factory line", "gopher://x.example/1"))
    assert row["rejected"] == 1 and row["events"] == 1 and row["health"] == "degraded"
    assert row["failed_sources"] == ["Invalid source records"]


def test_ids_continue_after_pruning(spark, folder):
    policy = Policy(mode="legacy", live_limit=2)
    rows = [article(i, f"Ransomware report number {i:03d} spreads", f"https://n.example/{i}") for i in range(5)]
    row = cycle(spark, folder, *rows, policy=policy)
    assert row["events"] == 2 and row["next_event_id"] == 6
    row = cycle(spark, folder, article(9, "Malware story after the pruning", "https://n.example/9"), as_of=AS_OF + 1, policy=policy)
    events, _ = current_state(Warehouse(spark, folder), row)
    assert events.agg(F.max("id")).first()[0] == 6 and row["next_event_id"] == 7


def test_history_appends_only_what_is_new(spark, folder):
    count = lambda table: Warehouse(spark, folder).read(table).count()
    cycle(spark, folder, A, B, policy=ARCHIVE)
    before = {t: count(t) for t in ("source_records", "source_revisions", "event_revisions", "source_observations")}
    assert before == {"source_records": 2, "source_revisions": 2, "event_revisions": 1, "source_observations": 2}
    cycle(spark, folder, A, B, as_of=AS_OF + 3_600_000, policy=ARCHIVE)
    assert count("source_records") == 2 and count("source_revisions") == 2 and count("event_revisions") == 1
    assert count("source_observations") == 4
    cycle(spark, folder, article(1, "Ransomware crew changes the headline", "https://one.example/a"), as_of=AS_OF + 7_200_000, policy=ARCHIVE)
    assert count("source_records") == 2 and count("source_revisions") == 3 and count("event_revisions") == 1
    assert count("event_evidence") == 2


def test_unlocated_article_is_observed_without_an_event(spark, folder):
    row = cycle(spark, folder, article(1, "Ransomware wave without any place", "https://one.example/x", lat="0", long="0"), policy=ARCHIVE)
    assert row["events"] == 0
    seen = Warehouse(spark, folder).read("source_observations").first()
    assert seen["normalization_outcome"] == "dropped:location"


def test_facts_without_a_pointer_are_invisible_and_overwritten(spark, folder):
    cycle(spark, folder, A)
    house = Warehouse(spark, folder)
    # A crash after writing facts of sequence 2, before its pointer.
    events = house.read("events", 1).drop("sequence")
    house.write("events", events.withColumn("title", F.lit("half written")), 2)
    assert house.committed() == 1 and house.read("events").count() == 1
    row = cycle(spark, folder, B, as_of=AS_OF + 1)
    assert row["sequence"] == 2 and row["events"] == 1
    assert house.read("events", 2).filter("title = 'half written'").count() == 0


def test_replay_is_ordered_and_repair_only_goes_forward(spark, folder):
    root, mirrors = f"{folder}/w", f"{folder}/m"
    cycle(spark, root, A)
    cycle(spark, root, B, as_of=AS_OF + 1)
    house = Warehouse(spark, root)
    assert pending(house) == [1, 2]
    assert replay(spark, root, mirrors) == [1, 2] and replay(spark, root, mirrors) == []
    assert not repair_mirrors(spark, root, mirrors)
    spark.createDataFrame([(99,)], "id bigint").write.mode("overwrite").json(f"{mirror_path(spark, mirrors)}/events")
    broken = mirror_path(spark, mirrors)
    assert repair_mirrors(spark, root, mirrors) and mirror_path(spark, mirrors) != broken
    docs = spark.read.json(f"{mirror_path(spark, mirrors)}/events")
    assert docs.count() == 1 and docs.first()["sources"] == ["https://one.example/a", "https://www.two.example/b"]


def test_tampered_sequence_stops_the_replay(spark, folder):
    root = f"{folder}/w"
    row = cycle(spark, root, A)
    house = Warehouse(spark, root)
    rows = house.read("events", row["sequence"]).drop("sequence").collect()
    changed = spark.createDataFrame(rows, house.read("events").drop("sequence").schema).withColumn("lat", F.lit(1.0))
    house.write("events", changed, row["sequence"])
    with pytest.raises(PayloadHashMismatch):
        replay(spark, root, f"{folder}/m")


def test_large_source_lists_continue_in_further_parts(spark):
    sources = spark.range(25).select(F.lit(1).cast("long").alias("id"), F.lit(1).cast("long").alias("origin"),
                                     F.col("id").alias("seq"), F.concat(F.lit("https://s.example/"), F.col("id").cast("string")).alias("url"))
    event = spark.sql("""SELECT 1L AS id, 'cyber' t, 'watching' sev, 'A title long enough' title, '' summary, 's' src, 'l' loc, 1.0D lat, 1.0D lon,
        1L ts, 1L ingested_at, 25L articles, 0.0D tone, 50 quality, 50 confidence, NULL image, NULL video_url, 'precise' geo_tier,
        'source' geo_source, NULL geo_policy, NULL geo_scope, NULL geo_evidence""")
    docs = documents(event, sources, inline=10).orderBy("part").collect()
    assert [len(d["sources"]) for d in docs] == [10, 10, 5]
    assert [u for d in docs for u in d["sources"]] == [f"https://s.example/{i}" for i in range(25)]


def test_unsafe_state_blocks_until_reaudited(spark, folder):
    root = f"{folder}/w"
    row = cycle(spark, root, article(1, "Malware found at a plant in Oslo", "https://one.example/o", lat="0", long="0"), A)
    house = Warehouse(spark, root)
    rows = house.read("events", 1).drop("sequence").collect()
    schema = house.read("events").drop("sequence").schema
    moved = spark.createDataFrame(rows, schema).withColumn("lat", F.when(F.col("geo_source") == "title", 0.5).otherwise(F.col("lat")))
    house.write("events", moved, row["sequence"])
    with pytest.raises(UnsafeLocations):
        cycle(spark, root, B, as_of=AS_OF + 1)
    result = reaudit(spark, root, f"{folder}/audit", AS_OF + 2)
    assert result["actions"] == {"updated": 1, "preservedSource": 1}
    assert cycle(spark, root, B, as_of=AS_OF + 3)["merged"] == 1
    assert current_manifest(house)["next_event_id"] == row["next_event_id"]


def test_import_is_idempotent_and_refuses_another_identity(spark, folder):
    old = f"{folder}/old"
    cycle(spark, old, A, article(2, "Tanker drifts after engine failure", "https://one.example/t"))
    events, sources = current_state(Warehouse(spark, old), {"state_sequence": 1, "events": 2})
    root = f"{folder}/new"
    with pytest.raises(BootstrapRequired):
        require_bootstrap(spark, root)
    first = import_state(spark, root, events, sources, "legacy:1", AS_OF, next_event_id=40)
    assert first["next_event_id"] == 40
    assert import_state(spark, root, events, sources, "legacy:1", AS_OF)["status"] == "already-imported"
    with pytest.raises(ValueError):
        import_state(spark, root, events, sources, "legacy:2", AS_OF)
    row = cycle(spark, root, B, article(5, "Navy escorts bulk carrier home", "https://x.example/5"), as_of=AS_OF + 1, policy=ARCHIVE)
    assert row["merged"] == 1 and row["next_event_id"] == 41
    # One field list for imported and live revisions: only the merged and the new event changed.
    assert Warehouse(spark, root).read("event_revisions", row["sequence"]).count() == 2


def test_shadow_history_failure_leaves_a_gap_and_publishes(spark, folder, monkeypatch):
    from tidewatch.plans import cycle as plan

    def broken(*_):
        raise RuntimeError("history is down")

    monkeypatch.setattr(plan, "record_history", broken)
    row = cycle(spark, folder, A, policy=Policy(mode="shadow"))
    assert row["events"] == 1
    assert Warehouse(spark, folder).read("gaps").first()["reason"] == "RuntimeError"
    with pytest.raises(RuntimeError):
        cycle(spark, folder, B, as_of=AS_OF + 1, policy=ARCHIVE)


def test_a_named_batch_takes_effect_once(spark, folder):
    rows = Batch(batch(spark, A, B))
    run_cycle(spark, folder, rows, AS_OF, PLAIN, token="ingest:0")
    again = run_cycle(spark, folder, rows, AS_OF, PLAIN, token="ingest:0")
    assert again == {"sequence": 1, "repeated": True} and Warehouse(spark, folder).committed() == 1


def test_fold_remembers_what_the_live_view_no_longer_shows(spark, folder):
    """Refetched articles and a late copy of events beyond the live limit meet their stories."""
    policy = Policy(mode="legacy", live_limit=2)
    stories = [article(i, f"Ransomware attack number {w} stops a brewery", f"https://one.example/{i}") for i, w in enumerate(("alpha", "beta", "gamma", "delta", "omega"))]
    first = run_cycle(spark, folder, Batch(batch(spark, *stories)), AS_OF, policy)
    again = run_cycle(spark, folder, Batch(batch(spark, *stories)), AS_OF + 60_000, policy)
    late = [article(i, f"Ransomware attack number {w} stops a brewery", f"https://two.example/{i}") for i, w in enumerate(("alpha", "omega"))]
    third = run_cycle(spark, folder, Batch(batch(spark, *late)), AS_OF + 120_000, policy)
    assert first["events"] == again["events"] == third["events"] == 2
    assert again["deduped"] == 5 and again["next_event_id"] == first["next_event_id"] == third["next_event_id"]
    assert third["merged"] == 2 and third["deduped"] == 0
