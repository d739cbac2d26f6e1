"""What the fold remembers, kept as a bucketed base and one small delta per sequence.

A cycle looks up only the keys of its batch. The base of a table is partitioned by a hash of its key, so a
lookup opens the buckets that its keys fall into and the deltas written since; a cycle writes only the rows it adds or changes.
Where a key has several rows, the one of the newest sequence counts. ``compact`` merges base and deltas into a
new base; the manifest of a sequence names the base it is read with, so a base becomes valid with its sequence and a crash
before that leaves the old one in place.

Membership of history tables is kept the same way: their base holds key columns only, and the tables
themselves serve as the deltas.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import hashing, urls
from tidewatch.operators import corroborate
from tidewatch.operators.normalize import story_key
from tidewatch.operators.numbering import first_per, top_per
from tidewatch.plans.warehouse import Warehouse, columns_of

#: Rows a bucket should hold, and the most buckets of a table. A lookup collects at most so many bucket numbers.
BUCKET_ROWS, MAX_BUCKETS = 10_000, 16_384


@dataclass(frozen=True)
class Base:
    """The base that a sequence is read with; generation 0 is none."""

    generation: int = 0
    buckets: int = 1

    @classmethod
    def of(cls, manifest: dict) -> Base:
        return cls(manifest.get("base_generation") or 0, manifest.get("base_buckets") or 1)


class Keyed:
    """A table of the warehouse as keyed state at one sequence.

    ``keys`` decide the bucket. With ``unique`` a key has one row, that of the newest sequence; ``index`` keeps
    only the key columns in the base.
    """

    def __init__(self, house: Warehouse, table: str, keys: list[str], at: int, base: Base, *, unique: bool = True, index: bool = False):
        self.house, self.table, self.keys, self.at, self.base, self.unique = house, table, keys, at, base, unique
        self.columns = keys if index else columns_of(table)

    def bucket(self, buckets: int | None = None) -> Column:
        return F.expr(f"CAST(pmod(xxhash64({', '.join(self.keys)}), {buckets or self.base.buckets}) AS int)")

    def _deltas(self) -> DataFrame:
        rows = self.house.load(self.table, self.columns)
        return rows.filter((F.col("sequence") > self.base.generation) & (F.col("sequence") <= self.at))

    def _base_path(self, generation: int) -> str:
        return f"{self.house.root}/{self.table}_base/generation={generation}"

    def base_rows(self, wanted: list[int] | None = None) -> DataFrame | None:
        """Rows of the base, of the wanted buckets only: partitions that are not wanted are not opened."""
        if not self.base.generation:
            return None
        rows = self.house.load_path(self._base_path(self.base.generation), self.table, self.columns, "sequence bigint, bucket int")
        return (rows if wanted is None else rows.filter(F.col("bucket").isin(wanted))).drop("bucket")

    def _newest(self, base: DataFrame | None, deltas: DataFrame) -> DataFrame:
        rows = deltas if base is None else base.unionByName(deltas)
        return top_per(rows, self.keys, 1, F.col("sequence").desc()).drop("rank") if self.unique else rows

    def read(self) -> DataFrame:
        """Every row of the state, with the sequence that wrote it."""
        return self._newest(self.base_rows(), self._deltas())

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Rows of the state whose key is among the wanted ones."""
        keys = wanted.select(*self.keys).distinct()
        numbers = [r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect()] if self.base.generation else None
        only = lambda rows: None if rows is None else rows.join(keys, self.keys, "left_semi")
        return self._newest(only(self.base_rows(numbers)), only(self._deltas()))

    def changed_since(self, sequence: int) -> DataFrame:
        """Rows that sequences after the given one wrote."""
        return self.read().filter(F.col("sequence") > sequence)

    def rebase(self, rows: DataFrame, generation: int, buckets: int) -> None:
        """Write a base. A bucket that holds very many rows (one hot key) is split over several tasks and files."""
        placed = rows.select(*self.columns, "sequence", self.bucket(buckets).alias("bucket"))
        placed.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._base_path(generation))


class FoldState:
    """All keyed tables of the fold at one sequence."""

    def __init__(self, house: Warehouse, at: int, base: Base):
        self.house, self.at, self.base = house, at, base
        keyed = lambda table, *keys, **kw: Keyed(house, table, list(keys), at, base, **kw)
        self.events = keyed("events", "id")
        self.event_sources = keyed("event_sources", "id", unique=False)
        self.urls = keyed("url_index", "url")
        self.stories = keyed("story_index", "story_key")
        self.outlets = keyed("outlet_index", "id", "host")
        self.source_keys = keyed("source_records", "natural_key", index=True)
        self.revision_keys = keyed("source_revisions", "source_uid", "content_hash", index=True)
        self.event_revision_keys = keyed("event_revisions", "event_uid", "semantic_hash", index=True)

    @classmethod
    def of(cls, house: Warehouse, manifest: dict) -> FoldState:
        return cls(house, manifest["state_sequence"], Base.of(manifest))

    def tables(self) -> list[Keyed]:
        return [x for x in vars(self).values() if isinstance(x, Keyed)]

    def compact(self, buckets: int | None = None) -> Base:
        """Merge base and deltas of every table into a base of this sequence."""
        rows = self.urls.read().select("url").count()
        base = Base(self.at, buckets or max(1, min(MAX_BUCKETS, -(-rows // BUCKET_ROWS))))
        for table in self.tables():
            table.rebase(table.read(), base.generation, base.buckets)
        return base


def outlet_host(url: Column) -> Column:
    return F.when(urls.is_http(url), F.lower(urls.outlet_host(url)))


def added_totals(new_sources: DataFrame, new_outlets: DataFrame) -> DataFrame:
    """What fresh sources add to each event's totals and to the folds that identify its set of URLs."""
    digest = hashing.set_digest(F.col("url"))
    per = new_sources.groupBy("id").agg(
        F.count("*").alias("d_articles"), F.count(outlet_host(F.col("url"))).alias("d_sources"), digest["x"].alias("d_x"), digest["y"].alias("d_y"))
    hosts = new_outlets.groupBy("id").agg(F.count("*").alias("d_outlets"))
    return per.join(hosts, "id", "left").fillna(0, ["d_outlets"])


def with_added(events: DataFrame, added: DataFrame) -> DataFrame:
    """Events with the totals of their fresh sources added; the others stay."""
    total = lambda name, more: (F.coalesce(name, F.lit(0)) + F.coalesce(more, F.lit(0))).cast("long")
    folded = lambda name, more: F.coalesce(name, F.lit(0)).bitwiseXOR(F.coalesce(more, F.lit(0)))
    joined = events.join(added, "id", "left")
    return joined.withColumns({
        "articles": total("articles", "d_articles"), "n_sources": total("n_sources", "d_sources"), "n_outlets": total("n_outlets", "d_outlets"),
        "set_x": folded("set_x", "d_x"), "set_y": folded("set_y", "d_y"),
    }).drop("d_articles", "d_sources", "d_outlets", "d_x", "d_y")


def seed(house: Warehouse, events: DataFrame, sources: DataFrame, sequence: int) -> DataFrame:
    """Write a whole state (an import, or a corrected one) as the deltas of one sequence; returns its events."""
    sources = house.write("event_sources", sources, sequence)
    house.write("url_index", first_per(sources, ["url"], F.col("id")), sequence)
    hosts = house.write("outlet_index", corroborate.outlets(sources).select("id", "host"), sequence)
    totals = ("articles", "n_sources", "n_outlets", "set_x", "set_y")
    bare = events.drop(*totals).withColumns({c: F.lit(0).cast("long") for c in totals})
    stored = house.write("events", with_added(bare, added_totals(sources, hosts)), sequence)
    stories = story_key(stored).withColumn("live_rank", live_rank())
    house.write("story_index", first_per(stories, ["story_key"], F.col("live_rank").asc(), F.col("id").desc()), sequence)
    return stored


def replace(house: Warehouse, before: FoldState, events: DataFrame, sources: DataFrame, sequence: int) -> tuple[DataFrame, Base]:
    """A corrected state as the base of a sequence: nothing of the state before remains but the history's keys."""
    stored, base = seed(house, events, sources, sequence), Base(sequence, before.base.buckets)
    for old, new in zip(before.tables(), FoldState(house, sequence, base).tables()):
        own = house.load(new.table, new.columns).filter(F.col("sequence") == sequence)
        new.rebase(old.read() if new.columns == new.keys else own, base.generation, base.buckets)
    return stored, base


def live_rank() -> Column:
    """Position in the live order, newest ingestion first."""
    return -F.coalesce("ingested_at", "ts")
