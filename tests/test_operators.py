"""Operators against brute force, and independence of partitioning."""

import math
import random

from pyspark.sql import functions as F
from tests.helpers import AS_OF, article, batch

from tidewatch.operators import checks, contract_paths, corroborate, relate, spatial, tracks
from tidewatch.operators.normalize import accepted, normalize
from tidewatch.operators.numbering import OrderSpan, number, number_within
from tidewatch.streaming.trails import advance_trails, stream_trails, trails_path


def test_numbering_is_dense_for_a_hot_key_and_any_partitioning(spark):
    rng = random.Random(1)
    rows = [(s, "hot" if rng.random() < 0.5 else f"k{s % 7}") for s in rng.sample(range(100_000), 900)]
    want, seen = {}, {}
    for s, k in sorted(rows):
        seen[k] = seen.get(k, 0) + 1
        want[s] = seen[k]
    for parts in (1, 13):
        df = spark.createDataFrame(rows, "seq long, k string").repartition(parts)
        span = OrderSpan.of(df, "seq", ranges=32)
        assert {r["seq"]: r["n"] for r in number_within(df, ["k"], span, "n").collect()} == want
        got = {r["seq"]: r["n"] for r in number(df, span, "n", start=5).collect()}
        assert got == {s: i + 5 for i, s in enumerate(sorted(want))}


def test_merge_equals_a_plain_loop_at_any_partitioning(spark):
    titles = ["Malware wave hits ports", "Navy finds drifting tanker", "Troops cross river bridge"]
    rng = random.Random(2)
    rows = [(i, rng.choice(titles) + rng.choice(["", "!"]), f"https://o{rng.randrange(4)}.example/{rng.randrange(25)}") for i in range(80)]
    known, keys, want = set(), {}, {}
    for _, title, url in rows:
        if url in known:
            continue
        known.add(url)
        key = title.rstrip("!")
        keys.setdefault(key, len(keys) + 1)
        want.setdefault(keys[key], []).append(url)
    for parts in (1, 9):
        reports = accepted(normalize(batch(spark, *(article(*r) for r in rows)).repartition(parts), AS_OF))
        none = reports.limit(0)
        events = none.withColumns({"id": F.lit(0).cast("long"), "live_rank": F.lit(0).cast("long")})
        merge = corroborate.merge_reports(reports, events, none.select(F.lit(0).cast("long").alias("id"), "seq", "url"), OrderSpan("seq", 0, 79), 1)
        got = {}
        for r in merge.new_sources.orderBy("seq").collect():
            got.setdefault(r["id"], []).append(r["url"])
        assert got == want


FIXES = "id string, clock long, lon double, lat double"
MINUTE = 60_000


def _trails(rows):
    return {r["id"]: [(p["ts"] // MINUTE, p["lon"]) for p in r["trail"]] for r in rows}


def test_trail_cases(spark):
    """Moves are kept, standing still is kept only when the last point grows old, and old points go."""
    steps = {
        "moves": [(0, 1.0), (1, 1.1), (2, 1.2)],
        "stands": [(0, 1.0), (1, 1.00001), (2, 1.0), (3, 1.0)],
        "returns": [(0, 1.0), (14, 1.1), (16, 1.2)],
        "many": [(m, 1.0 + m / 10) for m in range(12)],
    }
    rows = [(i, m * MINUTE, x, 2.0) for i, points in steps.items() for m, x in points]
    fixes = spark.createDataFrame(rows, FIXES)
    assert _trails(tracks.fold_trails(fixes, 15 * MINUTE).collect()) == {
        "moves": steps["moves"], "stands": [(0, 1.0), (2, 1.0)], "returns": [(0, 1.0), (14, 1.1)], "many": steps["many"][-8:],
    }


def test_trail_properties_hold_in_the_fold_and_in_the_stream(spark, folder):
    rng, policy = random.Random(3), tracks.TrailPolicy()
    rows = [(f"a{i}", m * MINUTE, rng.choice([1.0, 1.00001, 1.1]), rng.choice([2.0, 2.1])) for i in range(5) for m in range(16)]
    for name, wanted in (("1", range(8)), ("2", range(8, 16))):
        spark.createDataFrame([r for r in rows if r[1] // MINUTE in wanted], FIXES).coalesce(1).write.json(f"{folder}/in/{name}")
    fixes = spark.readStream.schema(FIXES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(f"{folder}/in")
    query = stream_trails(fixes, f"{folder}/trails").option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(150)
    finally:
        query.stop()
    streamed = spark.read.parquet(trails_path(f"{folder}/trails", 1)).collect()
    folded = tracks.fold_trails(spark.createDataFrame(rows, FIXES), 15 * MINUTE).collect()
    assert {r["id"]: r["trail"] for r in streamed} == {r["id"]: r["trail"] for r in folded}
    for r in folded:
        stamps = [p["ts"] for p in r["trail"]]
        assert 1 <= len(stamps) <= policy.points and stamps == sorted(set(stamps)) and stamps[0] >= 15 * MINUTE - policy.max_age_ms
        for p, q in zip(r["trail"], r["trail"][1:]):
            assert max(abs(p["lon"] - q["lon"]), abs(p["lat"] - q["lat"])) > policy.min_move or q["ts"] - p["ts"] >= policy.max_age_ms // 8


def test_objects_a_cycle_does_not_see_are_dropped(spark, folder):
    for number, rows in enumerate([[("a", 0, 1.0, 2.0), ("b", 0, 1.0, 2.0)], [("a", MINUTE, 1.1, 2.0)]]):
        advance_trails(spark.createDataFrame(rows, FIXES), folder, number)
    assert _trails(spark.read.parquet(trails_path(folder, 1)).collect()) == {"a": [(0, 1.0), (1, 1.1)]}


def test_arrival_order_counts_batches_before_places(spark):
    sources = spark.createDataFrame([(7, 1, 50, "https://a.example/1"), (7, 2, 1, "https://a.example/2")], "id long, origin long, seq long, url string")
    hints = spark.createDataFrame([("https://a.example/1", "early.jpg", None), ("https://a.example/2", "late.jpg", "v")], "url string, image string, video_url string")
    events = spark.createDataFrame([(7, None, None)], "id long, image string, video_url string")
    assert corroborate.media_hints(sources, hints, events).first() == (7, "early.jpg", "v")
    assert corroborate.outlets(sources).select("host", "first_origin", "first_seq").first() == ("a.example", 1, 50)


def _km(x1, y1, x2, y2):
    a = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * 6371 * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def test_counts_within_a_radius_across_seam_and_poles(spark):
    rng = random.Random(4)
    centers = [(0, 179.99, 0.0), (1, -179.99, 60.0), (2, 10.0, 89.95), (3, 0.0, -89.99), (4, 5.0, 45.0)]
    points = [(i, (c[1] + rng.uniform(-0.3, 0.3) + 540) % 360 - 180, max(-90.0, min(90.0, c[2] + rng.uniform(-0.3, 0.3))))
              for i, c in enumerate(rng.choices(centers, k=400))] + [(1000, -170.0, 89.95), (1001, 100.0, -89.99)]
    got = spatial.count_within(spark.createDataFrame(points, "point_id long, lon double, lat double"),
                               spark.createDataFrame(centers, "center_id long, lon double, lat double"))
    want = {c: sum(_km(x, y, px, py) < 14 for _, px, py in points) for c, x, y in centers}
    assert {r["center_id"]: r["n"] for r in got.collect()} == want


def test_candidates_are_the_rows_before_within_the_window(spark):
    rng = random.Random(5)
    rows = [(i, "cve", "hot" if rng.random() < 0.7 else "cold", i * 10, i) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, kind string, value string, ts long, ord long")
    got = {(r["id"], r["other_id"]) for r in relate.candidate_pairs(df, OrderSpan("ord", 0, 119, ranges=16), limit=7).collect()}
    want = set()
    for value in ("hot", "cold"):
        ids = [r[0] for r in rows if r[2] == value]
        want |= {(ids[j], ids[i]) for j in range(len(ids)) for i in range(max(0, j - 7), j)}
    assert got == want


def test_lineage_chains_resolve_and_cycles_fail(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(50, 60)], "old_id long, new_id long")
    got = {r["old_id"]: r["final_id"] for r in relate.resolve_lineage(chain).collect()}
    assert got == {**{i: 9 for i in range(9)}, 50: 60}
    import pytest
    with pytest.raises(ValueError):
        relate.resolve_lineage(spark.createDataFrame([(1, 2), (2, 1)], "old_id long, new_id long"), max_rounds=4)


def test_document_contract(spark):
    good = ('{"id":1,"t":"cyber","sev":"watching","title":"A long enough title","src":"s","loc":"l","lat":1,"lon":2,"ts":3,'
            '"sources":["https://x.example/1"],"score":{"articles":1,"tone":0.5}}')
    docs = [good, good.replace('"id":1', '"id":0'), good.replace('"id":1', '"id":1.5'), good.replace('"tone":0.5', '"tone":500'),
            good.replace('"sources":["https://x.example/1"]', '"sources":[]'), good[:-1] + ',"uid":"x"}',
            good[:-1] + ',"media":{"image":"data/media/x.png"}}', good[:-1] + ',"geo":{"tier":"exact","source":"title"}}', "[1]"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, payload string")
    got = [r["v"] for r in df.select("i", checks.document_violations().alias("v")).orderBy("i").collect()]
    assert got[:8] == [[], ["id"], ["id"], ["score"], ["sources"], ["unknown_field"], ["media_image"], ["geo"]]
    assert "not_an_object" in got[8]


def test_nothing_collects_a_hot_story(spark):
    """The first-per-key cut happens before the shuffle."""
    df = spark.range(1000).select(F.concat(F.lit("u"), (F.col("id") % 3).cast("string")).alias("url"), F.col("id").alias("seq"))
    plan = corroborate.first_per_url(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_entities_of_every_address_form_and_ending(spark):
    text = "See bank.co.uk, site.de, 999.999.1.1, 10.0.0.255, 10.0.0.0/8, 2001:db8::7 and 1:2:3:4:5:6:7:8 at 12:30:45."
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, body string")
    got = {(r["kind"], r["raw"]) for r in relate.entity_mentions(df, "id", "body").collect()}
    assert got == {
        ("domain", "bank.co.uk"), ("domain", "site.de"), ("ip", "10.0.0.255"), ("cidr", "10.0.0.0/8"),
        ("ip", "2001:db8::7"), ("ip", "1:2:3:4:5:6:7:8"),
    }


def test_only_the_newest_candidates_of_a_report_are_ranked(spark):
    pairs = spark.createDataFrame(
        [(9, 900, i, i * 100, "cve" if i == 1 else "ip", "v", "t", "r", "t", "r") for i in range(1, 5)],
        "id long, ts long, other_id long, other_ts long, kind string, value string, t string, region string, other_t string, other_region string",
    )
    assert [r["other_id"] for r in relate.rank_relations(pairs, top=5, candidates=4).orderBy("rank").collect()] == [1, 4, 3, 2]
    assert [r["other_id"] for r in relate.rank_relations(pairs, top=5, candidates=2).orderBy("rank").collect()] == [4, 3]


def test_pairs_are_ranked_in_the_task_that_makes_them(spark):
    day, limit = 86_400_000, 7
    rows = [(i, kind, f"v{i % n}", i * day, i, f"t{i % 2}", f"r{i % 3}") for i in range(300) if i % 11 for kind, n in (("cve", 23), ("ip", 2), ("organization", 150))]
    df = spark.createDataFrame(rows, "id long, kind string, value string, ts long, ord long, t string, region string").repartition(5)
    pairs = relate.candidate_pairs(df, OrderSpan("ord", 0, 299, ranges=16), limit=limit, carried=("t", "region"), rows=60)
    want, days = set(), {"cve": 365, "ip": 30, "organization": 30}
    for kind, value in {(r[1], r[2]) for r in rows}:
        ids = [r[0] for r in rows if r[1:3] == (kind, value)]
        want |= {(a, b, kind, value) for i, a in enumerate(ids) for b in ids[max(0, i - limit) : i] if a - b <= days[kind]}
    got = [(r["id"], r["other_id"], r["kind"], r["value"]) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert pairs.select("part").distinct().count() > 4
    exchanges = lambda x: x._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert exchanges(relate.rank_relations(pairs)) == exchanges(pairs.select("*"))


def test_a_contract_is_checked_in_one_pass_over_the_documents(spark, folder):
    contract = {"a": (2, {"b": "string?", "c": (1, "integer")}), "d": {"e": "boolean"}, "f": "any"}
    told = ['{"a": [{"b": null, "c": [1]}, {"b": "x"}], "d": {"e": true}, "f": [[{"z": 1}]]}', '{"a": [{"b": 1}, {"b": 2, "y": {"z": 1}}, {}], "d": []}',
            '{"a": {"c": 1}, "d": {"e": 1.5, "g": null}}', '{"a": [{"c": [1, 2, "x"]}], "f": null}', '[{"a": 1}]', '{', '{"a": 1, "a": 2}', None, 'null']
    spark.createDataFrame(list(enumerate(told)), "id int, body string").write.parquet(f"{folder}/docs")
    found = contract_paths.contract_violations(spark.read.parquet(f"{folder}/docs"), "id", "body", contract)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted(map(tuple, found.collect())) == [
        (1, ".a", "array_bound"), (1, ".a[].b", "wrong_type"), (1, ".a[].y", "unknown_field"), (1, ".d", "wrong_type"),
        (2, ".a", "wrong_type"), (2, ".a.c", "unknown_field"), (2, ".d.e", "wrong_type"), (2, ".d.g", "unknown_field"),
        (3, ".a[].c", "array_bound"), (3, ".a[].c[]", "wrong_type"), (4, "", "wrong_type"), (4, "[]", "unknown_field"),
        (5, "", "not_json"), (6, "", "not_json"), (7, "", "not_json"), (8, "", "wrong_type")]
