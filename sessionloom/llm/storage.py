"""Tables and files of the operators in the shared folder of the cluster."""

from __future__ import annotations

import math

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from sessionloom.cluster import batch_settings, cut_lineage, fresh_path

__all__ = ["batch_settings", "cut_lineage", "fresh_path", "parts_for", "store", "target"]


def store(df: DataFrame, label: str) -> DataFrame:
    """The rows written once to the shared folder and read back; survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def target(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a place in the shared folder, local or remote."""
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:") and not uri.startswith("file://"):
            uri = "file://" + uri[5:]
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def parts_for(total: int | None, each: int) -> int:
    """Number of parts of about ``each`` units."""
    return max(1, math.ceil((total or 0) / each))
