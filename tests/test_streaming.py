"""The stream of landed articles gives the batch result, once."""

import json
import os
import random

from tests.helpers import article

from tidewatch.plans.cycle import Policy, current_manifest
from tidewatch.plans.warehouse import Warehouse
from tidewatch.operators.tracks import update_trails
from tidewatch.operators.views import latest_snapshot
from tidewatch.streaming.ingest import drop_repeats, newest_snapshots, read_landing, read_newest, run_stream, stream_newest
from tidewatch.streaming.trails import advance_trails, trails_path


def test_stream_folds_each_landed_file_once(spark, folder):
    landing = f"{folder}/landing"
    os.makedirs(landing)
    files = [[article(1, "Ransomware stops a brewery", "https://one.example/1")],
             [article(2, "Ransomware stops a brewery!", "https://two.example/1"), article(3, "x", "https://one.example/1")]]
    for i, rows in enumerate(files):
        with open(f"{landing}/{i}.json", "w", encoding="utf-8") as out:
            out.writelines(json.dumps(r) + "\n" for r in rows)
        os.utime(f"{landing}/{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    for _ in range(2):
        query = run_stream(read_landing(spark, landing, files_per_batch=1), f"{folder}/w", f"{folder}/ckpt",
                           policy=Policy(mode="legacy"), interval=None)
        try:
            assert query.awaitTermination(200)
        finally:
            query.stop()
    house = Warehouse(spark, f"{folder}/w")
    manifest = current_manifest(house)
    assert house.committed() == 2 and manifest["events"] == 1 and manifest["merged"] == 1


def land(folder, name, rows, at):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w", encoding="utf-8") as out:
        out.writelines(json.dumps(r) + "\n" for r in rows)
    os.utime(f"{folder}/{name}.json", (1_700_000_000 + at, 1_700_000_000 + at))


def test_newest_snapshot_survives_late_arrivals_and_a_restart(spark, folder):
    schema = "view string, last_attempt long, last_sync long, arrival long"
    rows = [("a", 5, 1, 1), ("b", None, 4, 2), ("a", 9, 1, 3), ("a", 7, 8, 4), ("b", 4, 0, 5), ("c", None, 2, 6), ("b", 1, 9, 7)]
    names = schema.replace(" string", "").replace(" long", "").split(", ")
    for start in (0, 4):
        for i, row in list(enumerate(rows))[start : start + 4]:
            land(f"{folder}/in", str(i), [dict(zip(names, row))], i)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/in")
        query = stream_newest(stream, f"{folder}/out", f"{folder}/ckpt")
        try:
            assert query.awaitTermination(200)
        finally:
            query.stop()
    whole = spark.createDataFrame(rows, schema)
    want = {(r.view, r.stamp, r.arrival) for r in latest_snapshot(whole, ["view"]).select("view", "stamp", "arrival").collect()}
    assert {tuple(r) for r in read_newest(spark, f"{folder}/out").collect()} == want == {("a", 9, 3), ("b", 4, 5), ("c", 2, 6)}
    assert {tuple(r) for r in newest_snapshots(whole).collect()} == want


def test_repeated_articles_are_dropped_before_the_cycle(spark, folder):
    twice = article(1, "Ransomware stops a brewery", "https://one.example/1")
    renamed = article(2, "Ransomware crew leaves a brewery", "https://one.example/1")
    undated = article(3, "No date at all", "https://one.example/3", seendate="soon")
    for i, rows in enumerate(([twice, twice], [twice, renamed], [undated])):
        land(f"{folder}/in", str(i), rows, i)
    query = drop_repeats(read_landing(spark, f"{folder}/in", 1)).writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(200)
    finally:
        query.stop()
    assert sorted(r.title for r in spark.read.parquet(f"{folder}/out").collect()) == ["No date at all", "Ransomware crew leaves a brewery", "Ransomware stops a brewery"]


def test_many_cycles_of_a_batch_equal_cycles_one_by_one(spark, folder):
    draw, schema = random.Random(5), "id string, clock bigint, lon double, lat double"
    cycles = [[(f"a{i}", m * 60_000, draw.choice([1.0, 1.2]), 2.0) for i in range(4) if draw.random() < 0.8] for m in range(14)]
    cycles = [c for c in cycles if c]
    for number, part in enumerate((cycles[:9], cycles[9:])):
        advance_trails(spark.createDataFrame([r for c in part for r in c], schema), f"{folder}/many", number)
    one = None
    for rows in cycles:
        seen = spark.createDataFrame(rows, schema)
        one = update_trails(seen, spark.createDataFrame([], "id string, trail array<struct<lon:double,lat:double,ts:bigint>>") if one is None else one).select("id", "trail")
        one = spark.createDataFrame(one.collect(), one.schema)
    many = spark.read.parquet(trails_path(f"{folder}/many", 1)).select("id", "trail")
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.collect()))
    advance_trails(spark.createDataFrame([], schema), f"{folder}/many", 2)
    assert spark.read.parquet(trails_path(f"{folder}/many", 2)).count() == many.count()
    assert not os.path.exists(trails_path(f"{folder}/many", 0)) and os.path.exists(trails_path(f"{folder}/many", 1))
