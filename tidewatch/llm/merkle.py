"""Merkle manifest of a dataset: leaves, subtree roots by source, one root, and a checked proof for each row.

A row's leaf is the hash of its fields. Per source the leaves ascend by doc_id (null first; rows of one doc_id by
leaf; rows equal in every field may take each other's place); every ``fan`` neighbours become their hash until one
node is left. The roots of the sources, in the order of their names (null first, bytewise), form one more such tree.

Leaves get their places from a range partitioning and the counts of its parts, so a source of any size is
spread over all tasks. ``fan ** levels`` neighbours form a superblock, the unit of all tree work: on the way up each
superblock becomes one node of the tier above; on the way down its nodes are cogrouped with the outer nodes
they need (the siblings of all their ancestors), and one function builds the levels inside, joins the proofs
and folds them. Tiers above shrink by the size of a superblock each.

A null field is hashed as ``-``, so it differs from an empty one; a source without a name is a source of its own;
an only leaf is its source's root and an only source's root is the root; repeated rows are leaves each; an empty table
gives no rows. No text passes a shuffle: only digests do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of one part that share a key of the join with the part's first place.
SLOT = 256


@dataclass(frozen=True)
class Manifest:
    fan: int = 16
    levels: int = 2

    @property
    def block(self) -> int:
        return self.fan**self.levels


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(fields: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(_field(fields[name]) for name in FIELDS)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """k (the source, marked so that null comes first), name (doc_id as text), digest, and ``tampered`` where the row is altered."""
    fields = {name: F.col(name) for name in FIELDS}
    altered = fields | {"text": F.translate("text", UPPER, LOWER)}
    return docs.select(
        F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source"))).alias("k"),
        F.col("doc_id").cast("long").alias("place"), F.col("doc_id").cast("string").alias("name"), leaf_of(fields).alias("digest"),
        F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf_of(altered)).alias("tampered"),
    )


def _with_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each run of equal k; a run may go on in the next batch."""
    last, held = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("k").to_pandas().to_numpy()
        begins = np.flatnonzero(np.concatenate([[keys[0] != last], keys[1:] != keys[:-1]]))
        starts = np.zeros(len(keys), np.int64)
        starts[begins] = begins
        at = np.arange(len(keys)) - np.maximum.accumulate(starts)
        first = begins[0] if len(begins) else len(keys)
        at[:first] += held
        last, held = keys[-1], int(at[-1]) + 1
        yield batch.append_column("at", pa.array(at))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Add pos (place among the rows of one k, from 0) and n (their number)."""
    sorted_rows = rows.repartitionByRange("k", *order).sortWithinPartitions("k", *order).withColumn("part", F.spark_partition_id())
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in sorted_rows.schema)}, at long"
    counted = durable(sorted_rows.mapInArrow(_with_index, schema))
    runs = counted.groupBy("k", "part").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = runs.select("k", "part", "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"), F.sum("rows").over(Window.partitionBy("k")).alias("n"))
    places = places.select("k", "part", "first", "n", F.explode(F.expr(f"sequence(0L, (rows - 1) div {SLOT})")).alias("slot"))
    joined = counted.withColumn("slot", F.expr(f"at div {SLOT}")).join(places, ["k", "part", "slot"])
    return joined.select(*rows.columns, (F.col("first") + F.col("at")).alias("pos"), "n")


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _climb(nodes: list[str], total: int, p: Manifest) -> list[list[str]]:
    """The levels inside a superblock of a list of ``total`` nodes; the last holds one node."""
    tiers = [nodes]
    while total > 1 and len(tiers) <= p.levels:
        below = tiers[-1]
        tiers.append([_hash("".join(below[i : i + p.fan])) for i in range(0, len(below), p.fan)])
        total = -(-total // p.fan)
    return tiers


def _siblings(tiers: list[list[str]], i: int, fan: int) -> list[tuple[str, str]]:
    """For each level inside a superblock, what stands before and after the node on the way up from node i."""
    found = []
    for nodes in tiers[:-1]:
        first = i // fan * fan
        found.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + fan])))
        i //= fan
    return found


def _path_text(path: list[tuple[str, str]]) -> str:
    return ";".join(f"{before}|{after}" for before, after in path)


def _path(text: str) -> list[tuple[str, str]]:
    return [tuple(level.split("|")) for level in text.split(";")] if text else []


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a node and its siblings lead to."""
    for before, after in path:
        digest = _hash(before + digest + after)
    return digest


def _blocks(nodes: DataFrame, p: Manifest) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {p.block}"))


def raise_tiers(nodes: DataFrame, p: Manifest) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of nodes that the lists still need, lowest first, and each list's one top (k, digest)."""

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        total = int(rows["n"].iloc[0])
        top = _climb(rows["digest"].tolist(), total, p)[-1][0]
        return pd.DataFrame({"k": [rows["k"].iloc[0]], "pos": [int(rows["block"].iloc[0])], "n": [-(-total // p.block)], "digest": [top]})

    tiers, tops = [nodes], None
    while True:
        blocks = _blocks(tiers[-1], p).select("k", "block", "pos", "n", "digest")
        above = durable(blocks.groupBy("k", "block").applyInPandas(reduce, "k string, pos long, n long, digest string"))
        done = above.filter("n = 1").select("k", "digest")
        tops = done if tops is None else tops.unionByName(done)
        rest = above.filter("n > 1")
        if rest.isEmpty():
            return tiers, tops
        tiers.append(rest)


def _outer(nodes: DataFrame, above: DataFrame | None, tops: DataFrame, p: Manifest) -> DataFrame:
    """What each superblock of a tier needs from outside: k, block, path, top."""
    single = tops.join(nodes.filter((F.col("n") <= p.block) & (F.col("pos") == 0)).select("k"), "k", "left_semi")
    single = single.select("k", F.lit(0).cast("long").alias("block"), "path", "top")
    return single if above is None else single.unionByName(above.select("k", F.col("pos").alias("block"), "path", "top"))


def lower_tiers(tiers: list[DataFrame], tops: DataFrame, p: Manifest, finish, schema: str) -> DataFrame:
    """Bring the paths of the tops (k, path, top) down; ``finish`` makes the rows of the lowest tier from a superblock."""

    def hand_down(key: tuple, rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        inner, path = _climb(rows["digest"].tolist(), int(rows["n"].iloc[0]), p), outer["path"].iloc[0]
        paths = [";".join(filter(None, (_path_text(_siblings(inner, i, p.fan)), path))) for i in range(len(rows))]
        return pd.DataFrame({"k": key[0], "pos": rows["pos"].to_numpy(), "path": paths, "top": outer["top"].iloc[0]})

    above = None
    for nodes in reversed(tiers[1:]):
        joined = _blocks(nodes, p).groupBy("k", "block").cogroup(_outer(nodes, above, tops, p).groupBy("k", "block"))
        above = durable(joined.applyInPandas(hand_down, "k string, pos long, path string, top string"))
    lowest = _blocks(tiers[0], p).groupBy("k", "block").cogroup(_outer(tiers[0], above, tops, p).groupBy("k", "block"))
    return lowest.applyInPandas(finish, schema)


def manifest(docs: DataFrame, p: Manifest = Manifest()) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    nodes = durable(numbered(durable(leaves(docs)), "place", "digest"))
    tiers, subroots = raise_tiers(nodes, p)
    sources = durable(numbered(subroots.select(F.lit("").alias("k"), F.col("k").alias("name"), "digest"), "name"))
    source_tiers, roots = raise_tiers(sources, p)
    found = roots.collect()  # one row, none for an empty table
    root = found[0]["digest"] if found else ""

    def source_paths(key: tuple, rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        inner, path = _climb(rows["digest"].tolist(), int(rows["n"].iloc[0]), p), outer["path"].iloc[0]
        paths = [";".join(filter(None, (_path_text(_siblings(inner, i, p.fan)), path))) for i in range(len(rows))]
        return pd.DataFrame({"k": rows["name"].to_numpy(), "path": paths, "top": rows["digest"].to_numpy()})

    def proofs(key: tuple, rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        digests = rows["digest"].tolist()
        inner, path = _climb(digests, int(rows["n"].iloc[0]), p), _path(outer["path"].iloc[0])
        rest = "".join(before + after for before, after in path)
        proof, folded = [], []
        for i, (digest, tampered) in enumerate(zip(digests, rows["tampered"])):
            own = _siblings(inner, i, p.fan)
            proof.append(_hash("".join(before + after for before, after in own) + rest))
            folded.append(fold(tampered if isinstance(tampered, str) else digest, own + path))
        return pd.DataFrame({"name": rows["name"].to_numpy(), "leaf": digests, "subroot": outer["top"].iloc[0], "proof_sha256": proof, "folded_root": folded})

    start = sources.sparkSession.createDataFrame([("", "", root)], "k string, path string, top string")
    paths = durable(lower_tiers(source_tiers, start, p, source_paths, "k string, path string, top string"))
    proven = lower_tiers(tiers, paths, p, proofs, "name string, leaf string, subroot string, proof_sha256 string, folded_root string")
    return proven.select(
        F.col("name").cast("long").alias("doc_id"), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )
