"""Offline re-audit of stored locations: records, quarantine, and a corrected sequence."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import vocabulary as V
from tidewatch.functions.places_text import Gazetteer
from tidewatch.operators import views
from tidewatch.operators.audit import geo_audit
from tidewatch.plans.cycle import commit, current_manifest, full_state, live_rows
from tidewatch.plans.state import FoldState, replace
from tidewatch.plans.warehouse import Warehouse, table_digest


def reaudit(spark: SparkSession, root: str, audits: str, as_of_ms: int, gazetteer: Gazetteer | None = None) -> dict:
    """Re-derive every location, keep the evidence, and publish what is still supported.

    The audit is stored under the digest of its input, so running it twice on the same
    state cannot overwrite evidence of another state. Fetch clocks and the id high-water
    mark are kept: this is not a fetch.
    """
    house = Warehouse(spark, root)
    manifest = current_manifest(house)
    events, sources = full_state(house, manifest)
    digest = events.agg(table_digest(events)).first()[0]
    folder = f"{audits}/input_sha={digest}"
    geo_audit(events, gazetteer).write.mode("overwrite").parquet(f"{folder}/records")
    records = spark.read.parquet(f"{folder}/records")
    records.filter("action = 'quarantined'").select(*events.columns).write.mode("overwrite").parquet(f"{folder}/quarantine")
    tally = {r["action"]: r["n"] for r in records.groupBy("action").agg(F.count("*").alias("n")).collect()}

    kept = records.filter("action <> 'quarantined'").withColumns(
        {"lat": F.col("new_lat"), "lon": F.col("new_lon"), "loc": F.col("new_loc")}
    ).select(*events.columns)
    sequence = house.committed() + 1
    stored, base = replace(house, FoldState.of(house, manifest), kept, sources.join(kept.select("id"), "id", "left_semi"), sequence)
    house.write("live", views.live_events(stored, manifest.get("events") or V.LIVE_EVENTS), sequence)
    live = live_rows(FoldState(house, sequence, base))
    row = {
        **manifest, **views.manifest_counts(live).first().asDict(), "state_sequence": sequence,
        "base_generation": base.generation, "base_buckets": base.buckets,
    }
    row.pop("sequence", None)
    commit(house, sequence, f"publication-{sequence:012d}", row, live, as_of_ms, gazetteer=gazetteer)
    return {"sequence": sequence, "input_sha": digest, "actions": tally}
