"""Micro-batch ingestion: landed articles flow through the same cycle as a batch run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.functions import times
from tidewatch.plans.cycle import Batch, Policy, run_cycle
from tidewatch.schemas import ARTICLES


def read_landing(spark: SparkSession, landing: str, files_per_batch: int = 1000) -> DataFrame:
    """Landed article records as a stream; the schema is fixed."""
    return (
        spark.readStream.schema(ARTICLES).option("maxFilesPerTrigger", files_per_batch).json(landing)
    )


def clock_of_batch(batch: DataFrame) -> int:
    """A clock that depends on the data only, so a replayed batch gives the same result."""
    latest = batch.agg(F.max(times.parse_seendate(F.col("seendate")))).first()[0]
    return int(latest or 0) + times.HOUR_MS


def run_stream(
    articles: DataFrame,
    root: str,
    checkpoint: str,
    *,
    name: str = "ingest",
    clock: Callable[[DataFrame], int] = clock_of_batch,
    policy: Policy | None = None,
    interval: str | None = "15 minutes",
    repeats: str | None = None,
) -> StreamingQuery:
    """Start the ingest stream. ``interval=None`` processes what has landed and stops.

    One checkpoint admits one writer. Each micro-batch is published under its own token,
    so a batch replayed after a crash takes effect exactly once. Late articles are
    accepted: URL and story state live in the event tables, not in a watermark. ``repeats`` drops copies of a URL that
    arrive within that delay before they reach a cycle; what slips through is dropped there.
    """
    if repeats is not None:
        articles = drop_repeats(articles, repeats)

    def cycle(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            run_cycle(batch.sparkSession, root, Batch(batch), clock(batch), policy, token=f"{name}:{batch_id}")

    writer = articles.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def newest_snapshots(snapshots: DataFrame) -> DataFrame:
    """Running newest snapshot per view; an older arrival never replaces a newer one."""
    stamp = F.coalesce("last_attempt", "last_sync")
    return snapshots.groupBy("view").agg(F.max(F.struct(stamp.alias("stamp"), F.col("arrival"))).alias("newest")).select(
        "view", "newest.stamp", "newest.arrival"
    )


def stream_newest(snapshots: DataFrame, root: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Keep the newest snapshot of every view below ``root``: each batch writes the views it changed to a folder of its own.

    A batch repeated after a crash writes the same folder again. Read the table with :func:`read_newest`.
    """

    def upsert(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    writer = newest_snapshots(snapshots).writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"availableNow": True} if interval is None else {"processingTime": interval})).start()


def read_newest(spark: SparkSession, root: str) -> DataFrame:
    """One row per view: of its rows over all batches the newest."""
    rows = spark.read.schema("view string, stamp bigint, arrival bigint").parquet(root)
    return rows.groupBy("view").agg(F.max(F.struct("stamp", "arrival")).alias("n")).select("view", "n.stamp", "n.arrival")


def drop_repeats(articles: DataFrame, delay: str = "30 days") -> DataFrame:
    """Cheap streaming pre-filter of repeated articles (URL and title); the exact check stays in the cycle.

    An article whose date can't be read counts as seen now. Articles later than the delay do not pass.
    """
    seen = F.coalesce(F.timestamp_millis(times.parse_seendate(F.col("seendate"))), F.current_timestamp())
    dated = articles.withColumn("__seen", seen).withColumn("__url", F.coalesce("url", F.lit("")))
    return dated.withWatermark("__seen", delay).dropDuplicatesWithinWatermark(["__url", "title"]).drop("__seen", "__url")
