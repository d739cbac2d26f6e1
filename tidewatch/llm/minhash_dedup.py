"""MinHash near-dedup: universal hash minima in bands, signature and full-set verification, star components.

Every row ends in one class of equal shingle sets, and only one representative per class goes on, so exact
copies cost one row however many there are. Representatives that share a band bucket are not paired with each
other: in each turn every bucket draws one center from its largest component, every member outside that
component is tried once, with the center (of all its buckets) whose signature agrees best, and confirmed links merge components.
When a turn adds nothing, the members that are still apart from their bucket's largest component are compared with all
others there, so that no link is lost. Pairs inside a component are never formed.

Defined results: a null or blank text has an empty set and is its own component; a null doc_id is never
linked and is kept, with a null component; rows that repeat a doc_id count as one document; fewer words than
a shingle form one shingle. A pair at the threshold is missed by all bands with a probability of 1e-6, by
the signature check with 5e-6.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import BATCH_BYTES, Words, mix, pieces, starts_of, table_batch
from tidewatch.session import durable


#: Up to so many ids are broadcast to fetch their texts.
IDS_BROADCAST = 2_000_000


@dataclass(frozen=True)
class MinHash:
    """``percent``: link when 100 * intersection >= percent * union. ``agree``: least equal signature bits.
    ``turns``: most rounds of centers before the members left are compared one by one.
    ``fine``: signature bits of those; a pair at the threshold is missed with a probability of 4e-6."""

    shingle: int = 5
    percent: int = 80
    bands: int = 30
    rows: int = 4
    agree: int = 93
    turns: int = 3
    fine: int = 1536
    seed: int = 20_240_917

    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        draw = np.random.default_rng(self.seed).integers(0, 2**64, (2, self.bands * self.rows), np.uint64)
        return draw[0] | np.uint64(1), draw[1]


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes of the exact word sequences."""
    found = Words(texts)
    h, starts = found.hash, found.bounds
    odd = np.random.default_rng(7).integers(0, 2**63, width, np.uint64) * np.uint64(2) + np.uint64(1)
    size = max(0, len(h) - width + 1)
    rolled = np.zeros(size, np.uint64)
    for j in range(width):
        rolled += mix(h[j : j + size] + np.uint64(j)) * odd[j]
    rolled = mix(rolled)
    sets = []
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a >= width:
            sets.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:  # the whole sequence; its length keeps it apart from full shingles
            folded = sum(int(x) * int(o) for x, o in zip(h[a:b], odd)) + int(b - a)
            sets.append(mix(np.array([folded % 2**64], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each multiply-shift hash (a * x + b mod 2^64, upper half) over 32-bit keys."""
    best = np.full(len(a), 2**32 - 1, np.uint64)
    keys = values >> np.uint64(32)
    for at in range(0, len(keys), 2048):
        best = np.minimum(best, ((a[:, None] * keys[None, at : at + 2048] + b[:, None]) >> np.uint64(32)).min(axis=1))
    return best


SKETCH = "doc_id long, n long, k0 long, k1 long, s0 long, s1 long, bands array<long>"


def sketch(docs: DataFrame, p: MinHash) -> DataFrame:
    """Per row: set size, 128-bit set identity, one bit of each minimum, and a key per band."""
    out = pa.schema([(c, pa.int64()) for c in ("doc_id", "n", "k0", "k1", "s0", "s1")] + [("bands", pa.list_(pa.int64()))])

    def run(batches):
        a, b = p.coefficients()
        half = p.bands * p.rows // 2
        weights = np.uint64(1) << np.arange(half, dtype=np.uint64)
        for rows, texts in pieces(batches):
            sets = shingle_sets(texts, p.shingle)
            numbers = np.zeros((5, len(sets)), np.uint64)
            keys = np.zeros((len(sets), p.bands), np.uint64)
            for i, s in enumerate(sets):
                if not len(s):
                    continue
                low = minima(s, a, b)
                bits = low & np.uint64(1)
                numbers[:, i] = (
                    len(s), s.sum(), np.bitwise_xor.reduce(mix(s + np.uint64(1))), (bits[:half] * weights).sum(), (bits[half : 2 * half] * weights).sum(),
                )
                folded = np.arange(p.bands, dtype=np.uint64) + np.uint64(1)
                for column in low.reshape(p.bands, p.rows).T:
                    folded = mix(folded * np.uint64(0x9E3779B97F4A7C15) + column)
                keys[i] = folded
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * p.bands), pa.array(keys.view(np.int64).ravel()))
            yield table_batch(out, [rows.column(0), *(pa.array(x.view(np.int64)) for x in numbers), lists])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SKETCH)


def _sizes_fit(p: MinHash):
    return 100 * F.least("n", "c_n") >= p.percent * F.greatest("n", "c_n")


def _may_link(p: MinHash):
    """A pair (n, s0, s1) and (c_n, c_s0, c_s1) whose sizes and signatures leave the threshold possible."""
    agree = p.bands * p.rows - F.bit_count(F.col("s0").bitwiseXOR(F.col("c_s0"))) - F.bit_count(F.col("s1").bitwiseXOR(F.col("c_s1")))
    return _sizes_fit(p) & (agree >= p.agree), agree


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of some documents, written once for all verifications. Up to ``IDS_BROADCAST`` ids travel to the
    texts; beyond, both are shuffled."""
    few = ids.count() <= IDS_BROADCAST
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return durable(rows.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"))


def verified(texts: DataFrame, pairs: DataFrame, p: MinHash) -> DataFrame:
    """Keep the pairs (doc_id, other) whose full shingle sets reach the threshold."""
    out = pa.schema([("doc_id", pa.int64()), ("other", pa.int64())])

    def run(batches):
        for rows, left in pieces(batches, "x", BATCH_BYTES // 2):
            for part, right in pieces(iter([rows.append_column("at", pa.array(np.arange(rows.num_rows)))]), "y", BATCH_BYTES // 2):
                at = part.column(part.num_columns - 1).to_pylist()
                one, two = shingle_sets([left[i] for i in at], p.shingle), shingle_sets(right, p.shingle)
                shared = [len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(one, two)]
                linked = pa.array([100 * i >= p.percent * (len(a) + len(b) - i) for i, a, b in zip(shared, one, two)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], schema=out).filter(linked)

    first = pairs.join(texts.select("doc_id", F.col("text").alias("x")), "doc_id")
    both = first.join(texts.select(F.col("doc_id").alias("other"), F.col("text").alias("y")), "other")
    return both.select("doc_id", "other", "x", "y").mapInArrow(run, "doc_id long, other long")


def _are_stars(edges: DataFrame) -> bool:
    """No node of the edges (u, v) has two edges down, or one down and one up."""
    ends = edges.selectExpr("inline(array(struct(u AS node, 1 AS down, 0 AS up), struct(v AS node, 0 AS down, 1 AS up)))")
    roles = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return roles.filter("down > 1 OR down = 1 AND up = 1").isEmpty()


def star_components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """Connected components by alternating large-star and small-star: rows (node, component), component the smallest node.

    Nodes without an edge are not listed. Every round is written to the shared folder; it ends when the edges are
    stars around their smallest nodes. Equal edges of a round meet only in its last step, which makes them one.
    """
    now = durable(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct())
    while not _are_stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = durable(small.filter("u <> v").distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def fine_signatures(texts: DataFrame, p: MinHash) -> DataFrame:
    """doc_id and ``fine`` one-bit minima as columns f0, f1, … of 64 bits."""
    words = p.fine // 64
    draw = np.random.default_rng(p.seed + 1).integers(0, 2**64, (2, p.fine), np.uint64)
    out = pa.schema([("doc_id", pa.int64()), *((f"f{i}", pa.int64()) for i in range(words))])

    def run(batches):
        a, b = draw[0] | np.uint64(1), draw[1]
        weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
        for rows, raw in pieces(batches):
            sets = shingle_sets(raw, p.shingle)
            packed = np.zeros((len(sets), words), np.uint64)
            for i, s in enumerate(sets):
                for at in range(0, p.fine, 128):
                    bits = minima(s, a[at : at + 128], b[at : at + 128]) & np.uint64(1)
                    packed[i, at // 64 : at // 64 + 2] = (bits.reshape(2, 64) * weights).sum(axis=1)
            yield table_batch(out, [rows.column(0), *(pa.array(c) for c in packed.view(np.int64).T)])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"f{i} long" for i in range(words)))


def _fine_fits(p: MinHash):
    """Of a pair with f0, … and c_f0, …: equal bits leave the threshold possible."""
    differ = sum((F.bit_count(F.col(f"f{i}").bitwiseXOR(F.col(f"c_f{i}"))) for i in range(1, p.fine // 64)), F.bit_count(F.col("f0").bitwiseXOR(F.col("c_f0"))))
    equal = (1 + p.percent / 100) / 2
    return p.fine - differ >= int(p.fine * equal - 4.5 * (p.fine * equal * (1 - equal)) ** 0.5)


def _open(members: DataFrame, salt: int) -> DataFrame:
    """The members (key, doc_id, n, s0, s1, component) of buckets that hold several components, with the ``major`` one."""
    members = members.drop("major")
    parts = members.groupBy("key", "component").agg(F.count("*").alias("size"))
    top = F.max(F.struct("size", F.xxhash64("key", "component", F.lit(salt)), "component"))
    majors = parts.groupBy("key").agg(F.count("*").alias("parts"), top.alias("top")).filter("parts > 1")
    return durable(members.join(majors.select("key", F.col("top.component").alias("major")), "key"))


def _relabelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    found = members.drop("component").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return found.withColumn("component", F.coalesce("component", "doc_id"))


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components (node, component) after more links; those found before go on as one edge per node."""
    edges = links.select("doc_id", "other")
    return star_components(edges if labels is None else edges.union(labels.select("node", "component")), "doc_id", "other")


def linked_components(docs: DataFrame, reps: DataFrame, p: MinHash) -> DataFrame:
    """(node, component) of representatives that link to others."""
    banded = reps.select("doc_id", "n", "s0", "s1", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").select("key")
    members = durable(banded.join(shared, "key").withColumn("component", F.col("doc_id")))
    texts = texts_of(docs, durable(members.select("doc_id").distinct()))
    fits, agree = _may_link(p)
    center = [F.col(f"c.{x}").alias(f"c_{x}") for x in ("doc_id", "n", "s0", "s1")]
    labels = None
    for turn in range(p.turns):
        members = _open(members, turn)
        drawn = F.min(F.struct(F.xxhash64("doc_id", "key", F.lit(turn)), "doc_id", "n", "s0", "s1"))
        centers = members.filter("component = major").groupBy("key").agg(drawn.alias("c")).select("key", *center)
        tries = members.filter("component <> major").join(centers, "key").filter(fits)
        best = tries.groupBy("doc_id").agg(F.max(F.struct(agree.alias("a"), F.col("c_doc_id").alias("other"))).alias("b"))
        found = durable(verified(texts, best.select("doc_id", F.col("b.other").alias("other")), p))
        none = found.isEmpty()
        if not none:
            labels = _joined(labels, found)
            members = _relabelled(members, labels)
        if none:
            break
    # What is left: members still apart from their bucket's major component, against all others.
    members = _open(members, p.turns)
    left = members.select("doc_id").distinct()
    signed = durable(fine_signatures(texts.join(left, "doc_id", "left_semi").dropDuplicates(["doc_id"]), p))
    signed = durable(signed.join(reps.select("doc_id", "bands"), "doc_id"))
    members = members.drop("s0", "s1").join(signed, "doc_id")
    named = ["doc_id", "n", "component", *signed.columns[1:]]
    others = members.select("key", *(F.col(x).alias(f"c_{x}") for x in named))
    ordered = (F.col("c_component") == F.col("major")) | (F.col("doc_id") < F.col("c_doc_id"))
    # A pair counts in the smallest of the buckets it shares.
    once = F.col("key") == F.array_min(F.array_intersect("bands", "c_bands"))
    apart = (F.col("component") != F.col("c_component")) & ordered & _sizes_fit(p) & _fine_fits(p) & once
    minor = members.filter("component <> major").join(others, "key").filter(apart)
    pairs = durable(minor.select("doc_id", F.col("c_doc_id").alias("other")))
    if not pairs.isEmpty():
        found = durable(verified(texts, pairs, p))
        if not found.isEmpty():
            labels = _joined(labels, found)
    if labels is None:
        return reps.sparkSession.createDataFrame([], "node long, component long")
    return labels


def near_dedup(docs: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id), kept: one row per input row."""
    sketched = durable(sketch(docs, p))
    real = sketched.filter("n > 0 AND doc_id IS NOT NULL")
    same = [F.first(c).alias(c) for c in ("s0", "s1", "bands")]
    reps = real.groupBy("n", "k0", "k1").agg(F.min("doc_id").alias("doc_id"), *same)
    labels = linked_components(docs, reps, p)
    classes = reps.select("n", "k0", "k1", F.col("doc_id").alias("rep"))
    placed = sketched.select("doc_id", "n", "k0", "k1").join(classes, ["n", "k0", "k1"], "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    whole = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return placed.select("doc_id", F.col("n").alias("n_shingles"), whole.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
