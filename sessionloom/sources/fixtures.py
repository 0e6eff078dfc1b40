"""The test tables read as the inputs this library works on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.cluster import fresh_path
from sessionloom.functions.moments import micros
from sessionloom.sources.files import stage

DAY_MICROS = 24 * 3600 * 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def number_sessions(
    df: DataFrame,
    user: str,
    time: str,
    gap: int = DAY_MICROS,
    totals: dict[str, Column] | None = None,
) -> DataFrame:
    """Number the sessions of each user (a pause over ``gap`` microseconds starts a new one) and
    attach per-session sums, without ever sorting all events of a user in one task.

    Events are first summed up per user and time slot. A slot is shorter than the gap, so no
    session can start inside one: numbering the slots numbers the events. A user has at most one
    slot row per 1/24 gap of calendar time however many events they have, and the slot is part of
    the join key that brings the numbers back, so a user with a third of all rows is spread out.
    """
    totals = totals or {}
    slot = F.floor(micros(time) / F.lit(gap // 24)).alias("_slot")
    slots = df.groupBy(user, slot).agg(
        F.min(micros(time)).alias("_first"),
        F.max(micros(time)).alias("_last"),
        *[F.sum(column).alias(name) for name, column in totals.items()],
    )
    by_time = W.partitionBy(user).orderBy("_slot")
    pause = F.col("_first") - F.lag("_last").over(by_time)
    numbered = slots.withColumn(
        "_starts", F.when(pause.isNull() | (pause > gap), 1).otherwise(0)
    ).withColumn("session_no", F.sum("_starts").over(by_time))
    in_session = W.partitionBy(user, "session_no")
    numbered = numbered.select(
        user, "_slot", "session_no", *[F.sum(n).over(in_session).alias(n) for n in totals]
    )
    placed = df.withColumn("_slot", slot)
    sessions = numbered.select(
        F.col(user).alias("_user"), F.col("_slot").alias("_at"), "session_no", *totals
    )
    same = placed[user].eqNullSafe(sessions["_user"]) & placed["_slot"].eqNullSafe(sessions["_at"])
    return placed.join(sessions, same).drop("_user", "_at", "_slot")


def session_events(spark: SparkSession, folder: str) -> DataFrame:
    """The ``events`` table as an event log with sessions, a split and a session value."""
    raw = table(spark, folder, "events")
    log = number_sessions(raw, "user_id", "ts", totals={"total": F.col("value")})
    names = {"view": "VIEW", "click": "ADD_CART", "error": "REMOVE_CART", "purchase": "BUY"}
    event_type = F.lit("OTHER")
    for name, code in names.items():
        event_type = F.when(F.col("event_type") == name, code).otherwise(event_type)
    product = F.get_json_object("props", "$.k").cast("int")
    is_test = (F.col("user_id") + F.col("session_no")) % 5 == 0
    return log.select(
        "event_id",
        F.col("ts").alias("event_time"),
        event_type.alias("event_type"),
        F.concat(F.lit("PROD_"), product.cast("string")).alias("product_id"),
        F.concat(F.lit("CAT_"), (product % 10).cast("string")).alias("category_id"),
        "user_id",
        F.concat_ws("_", F.lit("SESSION"), "user_id", "session_no").alias("user_session"),
        F.when(is_test, "test").otherwise("train").alias("split"),
        F.when(~is_test, F.round("total", 2)).alias("session_value"),
        "value",
    )


def staged_events(spark: SparkSession, folder: str) -> DataFrame:
    """The event log written once as Parquet, for queries that read it several times."""
    return stage(session_events(spark, folder), fresh_path(spark, "events"))


# The same adapter for the SQL checks; a check starts with it and reads ``ev``.
EVENTS_SQL = """
WITH gaps AS (
  SELECT *, CASE WHEN prev_ts IS NULL OR date_diff('microsecond', prev_ts, ts) > 86400000000
                 THEN 1 ELSE 0 END AS starts
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_ts
        FROM events) AS with_prev),
numbered AS (
  SELECT *, CAST(sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                   ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM gaps),
valued AS (
  SELECT *, round(sum(value) OVER (PARTITION BY user_id, session_no), 2) AS total
  FROM numbered),
ev AS (
  SELECT event_id, ts AS event_time,
         CASE event_type WHEN 'view' THEN 'VIEW' WHEN 'click' THEN 'ADD_CART'
              WHEN 'error' THEN 'REMOVE_CART' WHEN 'purchase' THEN 'BUY' ELSE 'OTHER' END
           AS event_type,
         'PROD_' || k AS product_id, 'CAT_' || (k % 10) AS category_id, user_id,
         'SESSION_' || user_id || '_' || session_no AS user_session,
         CASE WHEN (user_id + session_no) % 5 = 0 THEN 'test' ELSE 'train' END AS split,
         CASE WHEN (user_id + session_no) % 5 <> 0 THEN total END AS session_value,
         value
  FROM valued)
"""


def baskets(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as an event log: the order is the session, its total price the value."""
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(parts, lines.l_partkey == parts.p_partkey)
        .select(
            F.col("l_orderkey").alias("user_session"),
            F.col("o_custkey").alias("user_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("p_brand").alias("category_id"),
            F.col("p_type").alias("product_type"),
            F.col("l_shipdate").alias("event_time"),
            F.concat("l_returnflag", "l_linestatus").alias("event_type"),
            F.col("l_linenumber").alias("event_id"),
            F.col("o_totalprice").alias("session_value"),
        )
    )


BASKETS_SQL = """
WITH ev AS (
  SELECT l_orderkey AS user_session, o_custkey AS user_id, l_partkey AS product_id,
         p_brand AS category_id, p_type AS product_type, l_shipdate AS event_time,
         l_returnflag || l_linestatus AS event_type, l_linenumber AS event_id,
         o_totalprice AS session_value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
"""
