"""Publishing committed sequences: ordered replay, mirrors, repair, import."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators import history, views
from tidewatch.operators.checks import document_violations
from tidewatch.operators.numbering import OrderSpan, number_within
from tidewatch.plans.cycle import BootstrapRequired, commit, current_state, live_rows
from tidewatch.plans.state import Base, FoldState, seed
from tidewatch.plans.warehouse import Warehouse, table_digest
from tidewatch.schemas import DOCUMENT
from tidewatch.session import drop_folder

INLINE_SOURCES = 10_000
POINTER = "sequence bigint, turn bigint, path string"


class PayloadHashMismatch(RuntimeError):
    """A stored sequence no longer matches the digest recorded when it was committed."""


class ContractBroken(RuntimeError):
    """A document to publish breaks the event contract."""


def documents(events: DataFrame, sources: DataFrame, inline: int = INLINE_SOURCES) -> DataFrame:
    """Contract-shaped event documents.

    Sources are inlined ``inline`` at a time in order of arrival; an event with more of
    them continues in further ``part`` documents, so no row grows with its story.
    """
    # One row per event and batch: the window below runs over these counts only.
    counted = sources.groupBy("id", "origin").agg(F.count("*").alias("n"))
    offset = counted.withColumn("before", F.coalesce(
        F.sum("n").over(Window.partitionBy("id").orderBy("origin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = number_within(sources, ["id", "origin"], OrderSpan.of(sources, "seq"), "in_batch")
    ordered = ranked.join(offset.select("id", "origin", "before"), ["id", "origin"]).withColumn(
        "position", F.col("before") + F.col("in_batch")
    )
    parts = ordered.withColumn("part", F.floor((F.col("position") - 1) / inline)).groupBy("id", "part").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "url"))), lambda s: s.url).alias("sources")
    )
    c = F.col
    return events.join(parts, "id").select(
        "id", "part", "t", "sev", "title", "summary", "src", "loc", "lat", "lon", "ts", c("ingested_at").alias("ingestedAt"), "sources",
        F.struct("articles", "tone", "quality", "confidence").alias("score"),
        F.when(c("image").isNotNull() | c("video_url").isNotNull(), F.struct("image", "video_url")).alias("media"),
        F.struct(c("geo_tier").alias("tier"), c("geo_source").alias("source"), c("geo_policy").alias("policy"),
                 c("geo_scope").alias("scope"), c("geo_evidence").alias("evidence")).alias("geo"),
    )


def states(house: Warehouse) -> DataFrame:
    """Latest state of every publication."""
    return history.latest(house.read("publications"), ["sequence"], F.col("state").desc())


def pending(house: Warehouse) -> list[int]:
    """Sequences committed but not yet published, ascending (a short list of numbers)."""
    return [r[0] for r in states(house).filter("state = 'pending'").select("sequence").orderBy("sequence").collect()]


def _live(house: Warehouse, sequence: int) -> tuple[DataFrame, DataFrame]:
    manifest = house.read("manifests", sequence).first().asDict()
    return current_state(house, manifest, manifest["events"] or 1)


def verify(house: Warehouse, sequence: int) -> None:
    """Recompute the digest of a sequence and stop on any difference."""
    live, _ = _live(house, sequence)
    recorded = house.read("publications", sequence).select("payload_hash").first()[0]
    if live.agg(table_digest(live)).first()[0] != recorded:
        raise PayloadHashMismatch(f"sequence {sequence}")


def replay(spark: SparkSession, root: str, mirrors: str) -> list[int]:
    """Publish pending sequences in order: verify, write the mirrors, then acknowledge.

    Repeating a sequence writes the same documents again, so a crash between the two
    writes is healed by the next replay.
    """
    house = Warehouse(spark, root)
    done = []
    for sequence in pending(house):
        verify(house, sequence)
        write_mirrors(house, sequence, mirrors)
        row = house.read("publications", sequence).first()
        house.append("publications", house.row(
            "publications", publication_uid=row["publication_uid"], state="published", payload_hash=row["payload_hash"],
            logged_at=row["logged_at"],
        ), sequence)
        done.append(sequence)
    return done


def write_mirrors(house: Warehouse, sequence: int, mirrors: str) -> None:
    """The event documents and the manifest of one sequence as JSON tables in a folder of their own, then the pointer to it.

    Nothing that a reader may have open is written over: a repeated or repaired sequence gets a new folder.
    """
    live, sources = _live(house, sequence)
    docs = documents(live, sources)
    payload = F.to_json(F.struct(*(c for c in docs.columns if c != "part")))
    # Feeds name images by address; the stored-path pattern applies to mirrored image files only.
    rules = F.filter(document_violations("payload"), lambda r: r != "media_image").alias("rules")
    broken = docs.select("id", payload.alias("payload")).select("id", rules).filter(F.size("rules") > 0).limit(1).first()
    if broken is not None:
        raise ContractBroken(f"event {broken['id']}: {', '.join(broken['rules'])}")
    copy = f"sequence={sequence}/copy={uuid.uuid4().hex}"
    docs.write.json(f"{mirrors}/{copy}/events")
    house.read("manifests", sequence).write.json(f"{mirrors}/{copy}/manifest")
    turn = pointers(house.spark, mirrors).count()
    row = house.spark.range(1).select(F.lit(sequence).cast("long").alias("sequence"), F.lit(turn).cast("long").alias("turn"), F.lit(copy).alias("path"))
    row.coalesce(1).write.mode("append").json(f"{mirrors}/pointers")


def pointers(spark: SparkSession, mirrors: str) -> DataFrame:
    """Every pointer written so far: sequence, turn, path."""
    try:
        return spark.read.schema(POINTER).json(f"{mirrors}/pointers")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], POINTER)


def mirror_path(spark: SparkSession, mirrors: str) -> str | None:
    """The folder of the newest sequence's newest copy, for readers; None before the first."""
    newest = pointers(spark, mirrors).agg(F.max(F.struct("sequence", "turn", "path")).alias("p")).first()["p"]
    return None if newest is None else f"{mirrors}/{newest['path']}"


def mirror_digest(spark: SparkSession, mirrors: str) -> str | None:
    path = mirror_path(spark, mirrors)
    try:
        rows = None if path is None else spark.read.schema(DOCUMENT).json(f"{path}/events")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = None
    return None if rows is None else rows.agg(table_digest(rows)).first()[0]


def repair_mirrors(spark: SparkSession, root: str, mirrors: str) -> bool:
    """Write a new copy when the mirrors are missing or differ from the newest published sequence; never older."""
    house = Warehouse(spark, root)
    newest = states(house).filter("state = 'published'").agg(F.max("sequence")).first()[0]
    if newest is None:
        return False
    live, sources = _live(house, newest)
    docs = documents(live, sources)
    if docs.agg(table_digest(docs)).first()[0] == mirror_digest(spark, mirrors):
        return False
    write_mirrors(house, newest, mirrors)
    return True


def vacuum(spark: SparkSession, root: str, mirrors: str | None = None, keep: int = 8) -> dict:
    """Delete what no reader can reach any more; returns how many folders went.

    The ``keep`` newest sequences stay readable, and with them every pending one. Gone are, of the fold's tables, bases before
    the one that the oldest of these is read with and the deltas merged into it, and in the mirrors all copies but the ``keep`` newest.
    History is kept whole.
    """
    house = Warehouse(spark, root)
    newest = house.committed()
    oldest = min([max(newest - keep + 1, 1), *pending(house)]) if newest else 0
    found = house.read("manifests", oldest).select("base_generation").first() if oldest else None
    generation = (found and found[0]) or 0
    gone = 0
    if generation:
        for keyed in FoldState(house, newest, Base()).tables():
            gone += _delete(spark, f"{house.root}/{keyed.table}_base", "generation=", lambda n: n < generation)
            if keyed.columns != keyed.keys:
                gone += _delete(spark, f"{house.root}/{keyed.table}", "sequence=", lambda n: n <= generation)
    if mirrors is not None:
        kept = {r["path"] for r in pointers(spark, mirrors).orderBy(F.desc("sequence"), F.desc("turn")).select("path").limit(keep).collect()}
        for sequence in _children(spark, mirrors, "sequence="):
            for copy in _children(spark, f"{mirrors}/{sequence}", "copy="):
                if f"{sequence}/{copy}" not in kept:
                    gone += drop_folder(spark, f"{mirrors}/{sequence}/{copy}")
    return {"oldest": oldest, "generation": generation, "deleted": gone}


def _children(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
    return sorted(n for n in names if n.startswith(prefix))


def _delete(spark: SparkSession, folder: str, prefix: str, old) -> int:
    return sum(drop_folder(spark, f"{folder}/{name}") for name in _children(spark, folder, prefix) if old(int(name.removeprefix(prefix))))


def import_state(spark: SparkSession, root: str, events: DataFrame, sources: DataFrame, identity: str, as_of_ms: int,
                 next_event_id: int = 1) -> dict:
    """Take over an existing event table as the first sequence; repeating the import changes nothing."""
    house = Warehouse(spark, root)
    known = house.read("event_mapping").drop("sequence")
    mapping = history.import_mapping(events, identity, known)
    clash = mapping.filter("conflict").limit(1).first()
    if clash is not None:
        raise ValueError(f"event {clash['id']} was imported under another identity")
    if house.committed():
        return {"status": "already-imported", "sequence": house.committed()}
    sequence = 1
    house.write("event_mapping", mapping, sequence)
    stored = seed(house, events, sources, sequence)
    house.write("live", stored, sequence)
    semantic = history.semantic_events(stored, sources)
    house.write("event_revisions", history.new_event_revisions(semantic, as_of_ms, None, "legacy_import"), sequence)
    water = history.high_water(stored, next_event_id).first()["next_id"]
    row = {
        **views.manifest_counts(stored).first().asDict(), "last_sync": 0, "last_attempt": as_of_ms, "next_event_id": water,
        "state_sequence": sequence, "health": "ok", "failed_sources": [], "ingested": 0, "deduped": 0, "merged": 0, "rejected": 0,
        "base_generation": 0, "base_buckets": 1, "history_sequence": sequence,
    }
    commit(house, sequence, f"import:{identity}", row, live_rows(FoldState(house, sequence, Base())), as_of_ms)
    return {"status": "imported", "sequence": sequence, "next_event_id": water}


def require_bootstrap(spark: SparkSession, root: str) -> None:
    if Warehouse(spark, root).committed() == 0:
        raise BootstrapRequired(f"{root} holds no published or imported state")
