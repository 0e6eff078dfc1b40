"""Session settings and the shared folder used by steps that have to cut lineage or write."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the joins rely on: a join side is broadcast only after AQE has measured it, and
# a hot key is split even where that costs one more exchange.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


ARROW_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def measured_broadcasts(spark: SparkSession) -> None:
    """A join side without a hint is broadcast only once AQE has measured it to be within the limit of the
    session. Spark's own guess is far too low after an explode and for packed files."""
    guessed, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    limit = spark.conf.get(guessed)
    if limit.startswith("-"):  # off already
        return
    if spark.conf.get(measured, None) is None:
        spark.conf.set(measured, limit)
    spark.conf.set(guessed, "-1")


def batch_settings(spark: SparkSession) -> None:
    """Arrow batches small enough that long texts do not fill a Python worker, the folder of this
    package on the path of workers started from elsewhere, and broadcasts of measured tables only."""
    measured_broadcasts(spark)
    for key, value in ARROW_SETTINGS.items():
        spark.conf.set(key, value)
    top, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if top not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (known, top) if x)


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster; where none is set, in local mode, one in the warehouse."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if path is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result lives in the shared folder and outlives executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a scan has fewer splits than that; many-file inputs stay as read.

    For steps that do much work per row (long texts) right after the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
