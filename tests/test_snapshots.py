"""Fallback chain of snapshots, mirrors by pointer, and retention."""

import glob
import os

from pyspark.sql import functions as F
from tests.helpers import AS_OF, article, batch

from tidewatch.operators import views
from tidewatch.plans.cycle import Batch, Policy, current_manifest, current_state, full_state, run_cycle
from tidewatch.plans.publication import mirror_path, pending, pointers, repair_mirrors, replay, vacuum
from tidewatch.plans.warehouse import Warehouse
from tidewatch.sources.snapshots import Place, read_snapshot


def put(path, *lines):
    os.makedirs(path)
    with open(f"{path}/part.json", "w", encoding="utf-8") as out:
        out.writelines(line + "\n" for line in lines)


def place(folder, name):
    return Place(name, f"{folder}/{name}/events", f"{folder}/{name}/manifest")


def test_the_first_usable_place_serves_with_defaults(spark, folder):
    put(f"{folder}/broken/events", '{"id": 1, "ts"', '{"id": 2}')
    put(f"{folder}/broken/manifest", '{"last_sync": 5}')
    put(f"{folder}/headless/events", '{"id": 1}')
    put(f"{folder}/two/events", '{"id": 1}')
    put(f"{folder}/two/manifest", '{"last_sync": 5}', '{"last_sync": 6}')
    put(f"{folder}/good/events", '{"id": 7, "title": "x"}', '{"id": 3}')
    put(f"{folder}/good/manifest", '{"last_sync": 5, "health": "degraded"}')
    chain = [place(folder, n) for n in ("gone", "broken", "headless", "two", "good")]
    found = read_snapshot(spark, chain)
    assert found.served == "good" and found.events.count() == 2
    assert found.manifest.first().asDict() == {"last_sync": 5, "last_attempt": 5, "next_event_id": 8, "events": 2, "health": "degraded"}
    none = read_snapshot(spark, chain[:4])
    assert none.served == "empty" and none.events.count() == 0
    assert none.manifest.first().asDict() == {"last_sync": 0, "last_attempt": 0, "next_event_id": 1, "events": 0, "health": "ok"}


def test_demo_comes_before_every_other_status(spark):
    rows = spark.createDataFrame([(1, 0, "error"), (2, AS_OF, "ok")], "id int, last_sync long, health string")
    assert {r.kind for r in views.freshness(rows, AS_OF, demo=True).collect()} == {"demo"}
    assert [r.kind for r in views.freshness(rows, AS_OF).orderBy("id").collect()] == ["error", "ok"]


def test_readers_see_whole_sequences_and_storage_stays_bounded(spark, folder):
    root, mirrors = f"{folder}/w", f"{folder}/m"
    policy = Policy(mode="legacy", compact_after=2, buckets=4)
    assert mirror_path(spark, mirrors) is None and vacuum(spark, root)["deleted"] == 0
    for at in range(5):
        run_cycle(spark, root, Batch(batch(spark, article(1, f"Ransomware attack number {at} stops a brewery", f"https://one.example/{at}"))), AS_OF + at, policy)
        if at == 1:
            replay(spark, root, mirrors)
            held = mirror_path(spark, mirrors)  # a reader that goes on reading this
    assert pending(Warehouse(spark, root)) == [3, 4, 5] and replay(spark, root, mirrors) == [3, 4, 5]
    assert spark.read.json(f"{held}/events").count() == 2 and pointers(spark, mirrors).count() == 5
    assert "sequence=5/" in mirror_path(spark, mirrors)
    assert not repair_mirrors(spark, root, mirrors)
    house = Warehouse(spark, root)
    before = [sorted(map(tuple, x.collect()), key=str) for x in full_state(house, current_manifest(house))]
    live = sorted(map(tuple, current_state(house, current_manifest(house))[0].collect()), key=str)
    done = vacuum(spark, root, mirrors, keep=2)
    assert (done["oldest"], done["generation"]) == (4, 4) and done["deleted"] > 0
    assert len(glob.glob(f"{mirrors}/sequence=*/copy=*")) == 2 and not glob.glob(f"{root}/events/sequence=[1-4]")
    assert glob.glob(f"{root}/events_base/generation=*") == [f"{root}/events_base/generation=4"]
    house = Warehouse(spark, root)
    assert [sorted(map(tuple, x.collect()), key=str) for x in full_state(house, current_manifest(house))] == before
    assert sorted(map(tuple, current_state(house, current_manifest(house))[0].collect()), key=str) == live
    row = run_cycle(spark, root, Batch(batch(spark, article(1, "Ransomware attack number 0 stops a brewery", "https://two.example/0"))), AS_OF + 9, policy)
    assert row["merged"] == 1 and row["events"] == 5
    assert full_state(Warehouse(spark, root), row | {"state_sequence": 6})[0].filter(F.col("articles") == 2).count() == 1
