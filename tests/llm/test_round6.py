"""Joins of the operators: a side is broadcast by what was measured, not by Spark's guess."""

import pytest
from pyspark.sql import functions as F

from sessionloom.llm import near_dedup

LIMITS = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]


@pytest.fixture
def limit(spark):
    before = {k: spark.conf.get(k, None) for k in LIMITS}
    spark.conf.unset(LIMITS[1])
    spark.conf.set(LIMITS[0], "256k")
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def joined(spark, times):
    """A table read beside one that Spark takes for small: an explode has ``times`` rows for each row."""
    near_dedup.sketches(spark.createDataFrame([(1, "some words")], "doc_id long, text string")).count()
    many = spark.range(100).select(F.explode(F.sequence(F.lit(1), F.lit(times))).alias("n"), F.col("id") + F.lit(1))
    df = spark.range(5_000_000).withColumn("n", F.col("id") % 7).join(many.distinct(), "n").groupBy("n").count()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_exploded_table_is_broadcast_only_if_it_was_measured_to_be_small(spark, limit):
    assert "BroadcastHashJoin" not in joined(spark, 1000).split("Initial Plan")[0]
    assert "BroadcastHashJoin" in joined(spark, 3).split("Initial Plan")[0]
    assert spark.conf.get(LIMITS[1]) == "256k"
