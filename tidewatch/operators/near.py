"""Near-duplicate reports by fingerprint, so that an evaluation split never parts them.

A text's fingerprint has 64 bits, each the majority of that bit over the hashes of its runs of words. Texts whose
fingerprints differ in at most ``bits`` bits are near-duplicates, and their connected groups are clusters. Pairs are found
through permuted tables: the 64 bits are cut into twice as many blocks as may differ, so half of the
blocks of a near pair agree, and each choice of half of the blocks is the key of one table. Equal fingerprints are one member, every
member of a bucket is first compared with the bucket's least one, and only members that are then still in different clusters meet.
No side of a join has a fixed size, so none is left to be broadcast: all are merged.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.staging import materialize
from tidewatch.session import durable

WIDTH, HALF = 64, 32


def word_list(text: Column) -> Column:
    """Words of a text, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def shingles(w: Column, words: int = 3) -> Column:
    """Runs of ``words`` words of a computed list, else it would be made again for every run; fewer words are one run, none none."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - words + 1, F.lit(1)))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(w, i, words), " "))
    return F.filter(runs, lambda x: x != "")


def fingerprints(df: DataFrame, key: str, text: str, words: int = 3) -> DataFrame:
    """(key, fingerprint) of every text that has words; sums combine map-side, so a long text costs one row."""
    told = materialize(df.select(key, text), {"__words": word_list(F.col(text))}).select(key, "__words")
    runs = told.select(key, F.explode(shingles(F.col("__words"), words)).alias("run"))
    halves = materialize(runs, {"h": F.md5("run")}).select(key, *(F.conv(F.substring("h", a, 8), 16, 10).cast("long").alias(n) for n, a in (("high", 1), ("low", 9))))
    vote = lambda half, i: F.sum(F.when(F.col(half).bitwiseAND(F.lit(1 << i)) != 0, 1).otherwise(-1)).alias(f"{half}{i}")
    votes = halves.groupBy(key).agg(*(vote(half, i) for half in ("high", "low") for i in range(HALF)))

    def bits(half: str) -> Column:
        total = F.lit(0).cast("long")
        for i in range(HALF):
            total = total + F.when(F.col(f"{half}{i}") > 0, F.lit(1 << i)).otherwise(0)
        return total

    return votes.select(key, F.shiftleft(bits("high"), HALF).bitwiseOR(bits("low")).alias("fingerprint"))


def block_masks(bits: int) -> list[int]:
    """Masks of the permuted tables: half of ``2 * bits`` blocks each (two blocks and one of them for 1 bit)."""
    blocks = max(2 * bits, 2)
    edges = [WIDTH * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << i for i in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(masks, blocks - max(bits, 1))]


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << WIDTH) if mask >> (WIDTH - 1) else mask).cast("long")


def _near(a: str, b: str, bits: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits


def _merged(side: DataFrame) -> DataFrame:
    """A side of a join to be sorted and merged. Spark goes by the compressed size of a written table, and does not count the
    rows that ``inline`` makes of one, so it might take a table of any size for a small one and send it whole through the driver."""
    return side.hint("merge")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, cluster): the least node reachable over ``edges`` (a, b); every node of ``nodes`` has a row.

    Each round gives a node the least label among its neighbours and then the label of its label, so rounds grow
    with the logarithm of the longest chain. Labels are a written table each round.
    """
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = durable(nodes.select("node", F.col("node").alias("cluster")))
    while True:
        around = both.join(_merged(labels.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("cluster").alias("least"))
        lower = labels.join(_merged(around), "node", "left").select("node", F.least("cluster", "least").alias("cluster"), F.col("cluster").alias("old"))
        jumped = lower.join(_merged(labels.select(F.col("node").alias("cluster"), F.col("cluster").alias("onward"))), "cluster")
        after = durable(jumped.select("node", F.least("cluster", "onward").alias("cluster"), "old"))
        labels = after.select("node", "cluster")
        if after.filter("cluster <> old").isEmpty():
            return labels


def near_clusters(df: DataFrame, key: str, text: str, bits: int = 3, words: int = 3) -> DataFrame:
    """(key, cluster): the least key of each text's group of near-duplicates; a text without words is its own group."""
    signed = durable(fingerprints(df, key, text, words))
    members = durable(signed.groupBy("fingerprint").agg(F.min(key).alias("rep")))
    tables = F.array(*(F.struct(F.lit(i).alias("table"), F.col("fingerprint").bitwiseAND(_signed(m)).alias("part")) for i, m in enumerate(block_masks(bits))))
    placed = members.select("rep", "fingerprint", F.inline(tables))
    least = placed.groupBy("table", "part").agg(F.min(F.struct("fingerprint", "rep")).alias("least"), F.count("*").alias("n")).filter("n > 1")
    buckets = durable(placed.join(_merged(least), ["table", "part"]).select("table", "part", "rep", "fingerprint", F.col("least.fingerprint").alias("first"), F.col("least.rep").alias("first_rep")))
    stars = durable(buckets.filter((F.col("rep") != F.col("first_rep")) & _near("fingerprint", "first", bits)).select(F.col("rep").alias("a"), F.col("first_rep").alias("b")).distinct())
    nodes = members.select(F.col("rep").alias("node"))
    labels = components(stars, nodes)
    own = durable(buckets.select("table", "part", "rep", "fingerprint").join(_merged(labels.withColumnRenamed("node", "rep")), "rep"))
    # Members that no bucket's least one has joined; buckets that are one cluster by now drop out.
    open_ = own.groupBy("table", "part").agg(F.min("cluster").alias("x"), F.max("cluster").alias("y")).filter("x <> y").select("table", "part")
    left = own.join(_merged(open_), ["table", "part"])
    right = left.select("table", "part", *(F.col(c).alias(f"o_{c}") for c in ("rep", "fingerprint", "cluster")))
    apart = left.join(_merged(right), ["table", "part"]).filter((F.col("cluster") < F.col("o_cluster")) & _near("fingerprint", "o_fingerprint", bits))
    links = stars.union(apart.select("rep", "o_rep").distinct())
    groups = components(links, nodes)
    found = signed.join(_merged(members), "fingerprint").join(_merged(groups.withColumnRenamed("node", "rep")), "rep").select(key, "cluster")
    return df.select(key).join(_merged(found), key, "left").select(key, F.coalesce("cluster", key).alias("cluster"))
