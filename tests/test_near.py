"""Near-duplicate clusters against all pairs of fingerprints; per-topic metrics."""

import hashlib
import random
import re
import time
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import near as N
from tidewatch.operators import relate as R
from tidewatch.operators.numbering import OrderSpan, number
from tidewatch.session import durable


def fingerprint_by_hand(text, words=3):
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    runs = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    if not runs:
        return None
    votes = [0] * 64
    for run in runs:
        h = int(hashlib.md5(run.encode()).hexdigest()[:16], 16)
        for i in range(64):
            votes[i] += 1 if h >> i & 1 else -1
    return sum(1 << i for i in range(64) if votes[i] > 0)


def clusters_by_hand(texts, bits):
    marks = {k: fingerprint_by_hand(t or "") for k, t in texts}
    top = {k: k for k in marks}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a, b in combinations(sorted(marks), 2):
        if marks[a] is not None and marks[b] is not None and (marks[a] ^ marks[b]).bit_count() <= bits:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {k: find(k) for k in marks}


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(12):
        told = [draw.choice(words) for _ in range(160)]
        for copy in range(6):
            rows.append(" ".join(told))
            told[draw.randrange(len(told))] = draw.choice(words)
    rows += [rows[0]] * 5 + ["", None, " ... ", "one", "ONE", "one two"]
    return list(enumerate(rows))


@pytest.mark.parametrize("bits", [1, 3, 6])
def test_clusters_equal_all_pairs(spark, texts, bits):
    docs = spark.createDataFrame(texts, "id long, body string")
    got = {r.id: r.cluster for r in N.near_clusters(docs, "id", "body", bits).collect()}
    want = clusters_by_hand(texts, bits)
    assert got == want and len(set(want.values())) < len(want)


def test_no_near_pair_crosses_the_split(spark, texts):
    docs = spark.createDataFrame(texts, "id long, body string")
    rows = N.near_clusters(docs, "id", "body").select("id", R.leakage_safe_split(F.col("cluster").cast("string")).alias("part")).collect()
    part, marks = {r.id: r.part for r in rows}, {k: fingerprint_by_hand(t or "") for k, t in texts}
    for a, b in combinations(marks, 2):
        if marks[a] is not None and marks[b] is not None and (marks[a] ^ marks[b]).bit_count() <= 3:
            assert part[a] == part[b]
    assert N.near_clusters(docs.limit(0), "id", "body").count() == 0


def test_every_near_pair_agrees_in_some_table():
    draw = random.Random(3)
    for bits in (1, 2, 3, 5):
        masks = N.block_masks(bits)
        for _ in range(300):
            flipped = sum(1 << i for i in draw.sample(range(64), bits))
            assert any(flipped & m == 0 for m in masks)


def test_a_long_text_is_cut_into_words_once(spark):
    draw = random.Random(5)
    told = " ".join(f"w{draw.randrange(5000)}" for _ in range(20_000))
    started = time.monotonic()
    rows = N.fingerprints(spark.createDataFrame([(1, told)], "id long, body string"), "id", "body").collect()
    assert [(r.id, r.fingerprint % 2**64) for r in rows] == [(1, fingerprint_by_hand(told))]
    assert time.monotonic() - started < 30  # cut again for every run, it took minutes


def test_no_table_passes_whole_through_the_driver(spark, texts, monkeypatch):
    plans = []

    def run(df):
        rows = df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return rows

    monkeypatch.setattr(N, "durable", lambda df: [run(df), durable(df)][1])
    docs = spark.createDataFrame(texts, "id long, body string")
    got = {r.id: r.cluster for r in run(N.near_clusters(docs, "id", "body"))}
    assert got == clusters_by_hand(texts, 3)
    # By size all would be broadcast here; at 1 GB so was a table of 9 million rows, by the size of the file that ``inline`` made it of.
    assert not [p for p in plans if "Broadcast" in p]
    assert sum("SortMergeJoin" in p for p in plans) > 3


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in (*range(31), 50, 51, 99)], "node long")
    got = {r.node: r.cluster for r in N.components(edges, nodes).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 50: 50, 51: 50, 99: 99}


def test_ranges_stay_even_under_outliers_and_far_apart_blocks(spark):
    ids = [(f << 20) + k for f in (0, 5, 6, 900_000) for k in range(500)] + [2**55]
    rows = spark.createDataFrame([(i,) for i in ids], "seq long").repartition(5)
    span = OrderSpan.of(rows, "seq", 40)
    sizes = [r["count"] for r in rows.groupBy(span.bucket().alias("b")).count().collect()]
    assert len(sizes) >= 38 and max(sizes) <= 2 * len(ids) / 40
    got = {r.seq: r.n for r in number(rows, span, "n").collect()}
    assert got == {x: i + 1 for i, x in enumerate(sorted(ids))}
    assert number(rows.limit(0), OrderSpan.of(rows.limit(0), "seq"), "n").count() == 0
    wide = OrderSpan.of(rows, "seq", 1024)
    assert {r.seq: r.n for r in number(rows, wide, "n", start=5).collect()} == {x: i + 5 for i, x in enumerate(sorted(ids))}
