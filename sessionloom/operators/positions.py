"""Positions in a sorted table, found without sending all rows through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.cluster import cut_lineage

ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in 33 bits


def number_in_order(df: DataFrame, order: str, name: str = "position") -> DataFrame:
    """Add the 0-based position of each row in the order of a unique column.

    Rows are range-sorted over all partitions and numbered inside each; the running total of
    partition sizes (one row per shuffle partition, so a small table) gives each partition its
    start. The checkpoint keeps both readings of the sorted rows identical.
    """
    placed = cut_lineage(df.sort(order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", ROW_BITS).alias("_part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    row = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .select(*df.columns, (F.col("_start") + row).alias(name))
    )
