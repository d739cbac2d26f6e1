"""Session settings the library relies on, and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Safe to set on a running session; nothing here sizes a cluster.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Only settable when the session starts. Recording a call site for every Column
# operation triples the time it takes to build a plan.
STARTUP_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "tidewatch", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**RUNTIME_SETTINGS, **STARTUP_SETTINGS, **settings}.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a local run without one gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="tidewatch-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write a result that several later steps read, and continue from the written table.

    Lost executors then cost no recomputation, and later steps still prune columns.
    """
    path = f"{shared_folder(df.sparkSession)}/tidewatch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.durable_path = path
    return written


def drop_durable(written: DataFrame) -> None:
    """Delete the table behind a result of ``durable`` that nothing will read again, such as a superseded round."""
    drop_folder(written.sparkSession, written.durable_path)


def drop_folder(spark: SparkSession, folder: str) -> bool:
    """Delete a folder of any file system; false if there was none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
