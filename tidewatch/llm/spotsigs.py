"""Document fingerprints by SpotSigs: chains of content words that follow common-word anchors.

Each occurrence of an anchor and the ``chain`` content words after it form one signature. A fingerprint is
the sorted set of a text's signatures, as hexadecimal 32-bit hashes. Likeness is the Jaccard similarity of two
sets, pruned by their lengths. For links between documents the sets are partitioned by length, so that only
neighbouring partitions can reach a similarity, and only sets that share one of their rarest signatures are compared.

Defined results: null, empty and word-less texts have the empty fingerprint (like 1 to each other, 0 to others); a text whose
anchors are followed by no content words takes every word as an anchor, then every single word.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Words, mix, pieces, table_batch
from tidewatch.session import durable

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "the a an of and to in is it that was for on are as with be by at from this or not but have "
    "le la les un une des de du et en est que qui dans pour par sur avec au aux ne pas "
    "der die das den dem ein eine und ist zu von mit im auf für nicht sich "
    "el los las del y es se no con por para su al lo"
).split()
_GAPS = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


@dataclass(frozen=True)
class SpotSigs:
    chain: int = 2
    percent: int = 80


_anchor_hashes = np.sort(Words([w.encode() for w in ANCHORS], _GAPS).hash)


def signature_sets(texts: list[bytes], p: SpotSigs) -> list[np.ndarray]:
    """Sorted distinct 32-bit signatures of each text."""
    found = Words(texts, _GAPS)
    common = np.isin(found.hash, _anchor_hashes)
    content = np.flatnonzero(~common)
    after = np.searchsorted(content, np.arange(len(common)), side="right")  # the first content word behind each word
    padded = np.append(found.hash[content], np.zeros(p.chain, np.uint64))
    place = np.append(content, np.full(p.chain, len(common)))
    chained = found.hash.copy()
    for k in range(p.chain):
        chained = mix(chained * np.uint64(0x9E3779B97F4A7C15) + padded[after + k])
    sets = []
    for a, b in zip(found.bounds[:-1], found.bounds[1:]):
        whole = place[after[a:b] + p.chain - 1] < b
        keep = common[a:b] & whole
        if not keep.any():
            keep = whole
        chosen = chained[a:b][keep] if keep.any() else mix(found.hash[a:b] + np.uint64(1))
        sets.append(np.unique((chosen >> np.uint64(32)).astype(np.uint32)))
    return sets


def fingerprint(signatures: np.ndarray) -> str:
    return signatures.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity; 0 as soon as the lengths alone keep it below ``least``."""
    small, large = sorted((len(a), len(b)))
    if large == 0:
        return 1.0
    if small == 0 or small < least * large:
        return 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (small + large - shared)


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the following one's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_following(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id, text and ``last`` (true on rows that only serve as the next document of the row before), dealt into ranges.

    Rows are in order of descending doc_id, ties by text, nulls last, inside each partition; a range's last row
    is followed by a copy of the next range's first, and the last document by the first. Bounds are a few quantiles of doc_id.
    """
    spark = docs.sparkSession
    n = partitions or max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = sorted(set(rows.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n))))
    # Ranges by binary search; ids that one double stands for share a range, and the lowest one holds missing ids.
    ends = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="place", outputCol="range") if cuts else None
    placed = rows.withColumn("place", F.coalesce(F.col("doc_id").cast("double"), F.lit(-math.inf)))
    number = ends.transform(placed) if ends else placed.withColumn("range", F.lit(0))
    ranged = number.select("doc_id", "text", (F.lit(len(cuts)) - F.col("range")).cast("int").alias("part"))
    # One row per range: where it starts, and the range before it that has rows. At most n rows.
    heads = ranged.groupBy("part").agg(F.max("doc_id").alias("head")).orderBy("part").collect()
    before = {r.part: heads[i - 1].part for i, r in enumerate(heads)}
    if not heads:
        return ranged.withColumn("last", F.lit(False))
    table = spark.createDataFrame([(r.part, r.head, before[r.part]) for r in heads], "part int, head long, before int")
    firsts = ranged.join(F.broadcast(table), (ranged["part"] == table["part"]) & ranged["doc_id"].eqNullSafe(table["head"]))
    firsts = firsts.groupBy("before").agg(F.max("doc_id").alias("doc_id"), F.min("text").alias("text"))
    copies = firsts.select("doc_id", "text", F.col("before").alias("part"), F.lit(True).alias("last"))
    dealt = ranged.withColumn("last", F.lit(False)).unionByName(copies).repartitionByRange(len(heads), "part")
    return dealt.sortWithinPartitions("part", "last", F.desc_nulls_last("doc_id"), "text")


def edited_pairs(docs: DataFrame, p: SpotSigs = SpotSigs()) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, both fingerprints, and likeness to the edited text and the next document."""
    out = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_signatures", pa.int64()),
    ])

    def run(batches):
        held = None  # the row before: part, doc_id, text, signatures
        for rows, raw in pieces(batches):
            texts = [t.decode() for t in raw]
            sets = signature_sets(raw, p)
            ids, parts, lasts = (rows.column(i).to_pylist() for i in (0, 2, 3))
            pairs = []
            for i, text in enumerate(texts):
                if held is not None and held[0] == parts[i]:
                    pairs.append((held[1:], (ids[i], text, sets[i])))
                held = None if lasts[i] else (parts[i], ids[i], text, sets[i])
            if not pairs:
                continue
            changed = [edited(own[1], following[1]) for own, following in pairs]
            coded = [t.encode() for t in changed]
            done = [
                (own[0], len(own[1]), hashlib.sha256(c).hexdigest(), fingerprint(own[2]), fingerprint(s), likeness(own[2], s), likeness(own[2], following[2]), len(own[2]))
                for (own, following), c, s in zip(pairs, coded, signature_sets(coded, p))
            ]
            yield table_batch(out, list(zip(*done)))

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long"
    return with_following(docs).mapInArrow(run, kinds)


def length_partition(n, percent: int):
    """Partition of a set length: lengths whose ratio reaches ``percent`` lie in the same or the next one."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(100 / percent)) + 1e-9).cast("int")


def near_pairs(docs: DataFrame, p: SpotSigs = SpotSigs()) -> DataFrame:
    """doc_id, other (the smaller id): representatives of equal fingerprints whose likeness reaches ``p.percent``; and members.

    Returns rows (doc_id, other, likeness): for texts of equal fingerprint a row to their smallest id with likeness 1, and between those
    smallest ids all pairs that reach the threshold. Texts without signatures are linked with none.
    """
    out = pa.schema([("doc_id", pa.int64()), ("sigs", pa.list_(pa.int64()))])

    def run(batches):
        for rows, texts in pieces(batches):
            yield table_batch(out, [rows.column(0), pa.array([s.astype(np.int64) for s in signature_sets(texts, p)], out[1].type)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    signed = durable(rows.mapInArrow(run, "doc_id long, sigs array<long>").filter(F.size("sigs") > 0))
    same = durable(signed.groupBy("sigs").agg(F.min("doc_id").alias("other")))
    members = signed.join(same, "sigs").filter("doc_id <> other").select("doc_id", "other", F.lit(1.0).alias("likeness"))
    reps = same.select(F.col("other").alias("doc_id"), "sigs", F.size("sigs").alias("n"))
    uses = reps.select(F.explode("sigs").alias("s")).groupBy("s").agg(F.count("*").alias("uses"))
    # Two sets that reach the threshold share a signature among the first n - ceil(t * n) + 1 in order of rareness.
    ordered = reps.select("doc_id", "n", F.explode("sigs").alias("s")).join(uses, "s").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("uses", "s"))).alias("o"))
    first = F.slice("o", 1, F.col("n") - F.ceil(F.col("n") * p.percent / 100).cast("int") + 1)
    keys = durable(ordered.select("doc_id", "n", length_partition(F.col("n"), p.percent).alias("part"), F.explode(first).alias("k")).select("doc_id", "n", "part", "k.s"))
    left = keys.select("doc_id", "n", "s", "part")
    right = keys.select(F.col("doc_id").alias("other"), F.col("n").alias("m"), "s", F.explode(F.array(F.col("part") - 1, "part", F.col("part") + 1)).alias("part"))
    fits = (100 * F.least("n", "m") >= p.percent * F.greatest("n", "m")) & (F.col("other") < F.col("doc_id"))
    pairs = left.join(right, ["s", "part"]).filter(fits).select("doc_id", "other").distinct()
    full = pairs.join(reps.select("doc_id", F.col("sigs").alias("x")), "doc_id").join(reps.select(F.col("doc_id").alias("other"), F.col("sigs").alias("y")), "other")
    shared = full.select("doc_id", "other", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("t"))
    near = shared.filter(100 * F.col("i") >= p.percent * (F.col("t") - F.col("i"))).select("doc_id", "other", (F.col("i") / (F.col("t") - F.col("i"))).alias("likeness"))
    return near.union(members)
