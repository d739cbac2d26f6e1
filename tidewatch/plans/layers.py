"""Independent map layers (aircraft, hosts): each is published on its own, and a failure keeps the last good one."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.plans.warehouse import Warehouse

log = logging.getLogger(__name__)


def publish_layers(
    spark: SparkSession, root: str, layers: Mapping[str, Callable[[], DataFrame]], as_of_ms: int
) -> list[str]:
    """Write every layer under ``layers/<name>/stamp=<as_of>`` and then its pointer; returns the names that failed.

    Readers follow the pointer, so a layer that could not be built or written leaves its
    previous version in place, and one failing layer does not hold back the others.
    """
    house, failed = Warehouse(spark, root), []
    for name, build in layers.items():
        path = f"{house.root}/layers/{name}/stamp={as_of_ms}"
        try:
            build().write.mode("overwrite").parquet(path)
            rows = spark.read.parquet(path).count()
            house.append("layer_pointers", house.row("layer_pointers", name=name, stamp=as_of_ms, objects=rows), 0)
        except Exception as error:  # noqa: BLE001 — a source failure belongs to its layer only
            log.warning("layer %s kept its previous version: %s", name, type(error).__name__)
            failed.append(name)
    return failed


def layer_table(spark: SparkSession, root: str) -> DataFrame:
    """Newest published version of every layer: name, load time, rows."""
    pointers = Warehouse(spark, root).ledger("layer_pointers")
    newest = pointers.groupBy("name").agg(F.max(F.struct("stamp", "objects")).alias("p"))
    return newest.select("name", F.col("p.stamp").alias("loaded_at"), F.col("p.objects").alias("rows"))


def read_layer(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The rows of a layer's newest version; None before its first."""
    found = layer_table(spark, root).filter(F.col("name") == name).first()
    return None if found is None else spark.read.parquet(f"{root.rstrip('/')}/layers/{name}/stamp={found['loaded_at']}")
