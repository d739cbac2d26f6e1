"""Reading the newest usable snapshot from an ordered list of places."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "id bigint, t string, sev string, title string, ts bigint, ingestedAt bigint"
MANIFEST = "last_sync bigint, last_attempt bigint, next_event_id bigint, events bigint, health string"
_BROKEN = "_broken"


@dataclass(frozen=True)
class Place:
    """Where a snapshot may lie: folders of JSON event documents and of a one-row manifest."""

    name: str
    events: str
    manifest: str


@dataclass(frozen=True)
class Snapshot:
    """What was read, and the name of the place that served it (``empty`` if none did)."""

    served: str
    events: DataFrame
    manifest: DataFrame


def _usable(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The rows under a path; None if it does not exist or holds a record that is no JSON of the schema."""
    try:
        rows = spark.read.schema(f"{schema}, {_BROKEN} string").option("columnNameOfCorruptRecord", _BROKEN).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    # A whole row is asked for: a reader of the broken column alone would not parse the rest.
    if rows.filter(F.col(_BROKEN).isNotNull()).head(1):
        return None
    return rows.drop(_BROKEN)


def with_defaults(manifest: DataFrame, events: DataFrame) -> DataFrame:
    """Counters that an older writer left out: the next id follows the greatest, the last attempt is the last success."""
    found = events.agg(F.count("*").alias("n"), F.coalesce(F.max("id") + 1, F.lit(1)).alias("after"))
    return manifest.crossJoin(F.broadcast(found)).select(  # one row each
        F.coalesce("last_sync", F.lit(0)).alias("last_sync"), F.coalesce("last_attempt", "last_sync", F.lit(0)).alias("last_attempt"),
        F.coalesce("next_event_id", "after").alias("next_event_id"), F.coalesce("events", "n").alias("events"), F.coalesce("health", F.lit("ok")).alias("health"),
    )


def read_snapshot(spark: SparkSession, places: Sequence[Place], events_schema: str = EVENTS) -> Snapshot:
    """The first place whose events and one-row manifest can be read; without any, an empty snapshot."""
    for place in places:
        events = _usable(spark, place.events, events_schema)
        manifest = None if events is None else _usable(spark, place.manifest, MANIFEST)
        if manifest is not None and len(manifest.limit(2).collect()) == 1:
            return Snapshot(place.name, events, with_defaults(manifest, events))
    none = spark.createDataFrame([], events_schema)
    return Snapshot("empty", none, with_defaults(spark.range(1).selectExpr(*(f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in MANIFEST.split(", "))), none))
