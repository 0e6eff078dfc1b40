"""User, product and category tables and their way back to event rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.functions.fixed_values import EVENT_TYPES
from sessionloom.functions.moments import seconds_between
from sessionloom.functions.ratios import key_hash, plain_ratio
from sessionloom.operators.lookup import attach
from sessionloom.operators.sessions import KEY, count_of


def user_history(train: DataFrame) -> DataFrame:
    """Mean label, distinct sessions and purchases of each known user, from labelled rows."""
    return train.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.avg("session_value").alias("user_avg_session_value"),
        F.countDistinct(KEY).alias("user_session_count"),
        count_of("BUY").alias("user_buy_count"),
    )


def inferred_prices(train: DataFrame) -> DataFrame:
    """Mean label of the purchases of a product."""
    bought = train.where((F.col("event_type") == "BUY") & F.col("product_id").isNotNull())
    return bought.groupBy("product_id").agg(F.avg("session_value").alias("inferred_price"))


def category_popularity(train: DataFrame) -> DataFrame:
    """Purchases per category."""
    bought = train.where((F.col("event_type") == "BUY") & F.col("category_id").isNotNull())
    return bought.groupBy("category_id").agg(F.count("*").alias("category_popularity"))


def label_mean(train: DataFrame) -> Column:
    return train.agg(F.avg("session_value")).scalar()


def target_mean(df: DataFrame, key: str, label: str, fit_on: DataFrame, to: str) -> DataFrame:
    """Mean label per key from the fitted rows; null for unseen keys."""
    known = fit_on.where(F.col(key).isNotNull())
    return attach(df, known.groupBy(key).agg(F.avg(label).alias(to)), key)


SLOT_ROWS = 1_000_000
HASH_BITS = 60


def ordered_target_mean(
    df: DataFrame, row_key: str, value: str, label: str, to: str,
    prior: float = 1.0, seed: int = 42, slot_rows: int = SLOT_ROWS,
) -> DataFrame:
    """Mean label of the earlier rows of the same value, so that no row's own label is in its mean.

    Rows are ordered by a seeded hash of their key. The mean of all labels counts as ``prior`` rows.
    Rows without a label come after all others: they see every label of their value. Rows with the same
    key (null keys too) do not see each other; null is a value of its own; without any label all means
    are null. A column ``to`` is replaced.

    The order is cut into slots of about ``slot_rows`` rows. Sums of whole slots run over one row for
    each value and slot, single rows only over their own slot, so a hot value is spread over its slots.
    """
    totals = df.agg(F.count(label).alias("labels"), F.avg(label).alias("mean"), F.count("*").alias("n")).first()
    bits = max(0, math.ceil(math.log2(max(totals["n"], 1) / slot_rows)))
    rows = df.select(
        F.struct(*[F.col(c) for c in df.columns if c != to]).alias("_row"),
        F.col(value).alias("_value"), F.col(label).cast("double").alias("_label"),
        key_hash(row_key, seed).alias("_place"),
    )
    late = F.when(F.col("_label").isNull(), F.lit(1 << bits)).otherwise(F.lit(0))
    rows = rows.withColumn("_slot", F.shiftright("_place", HASH_BITS - bits) + late)
    slots = rows.groupBy(F.col("_value").alias("_of"), F.col("_slot").alias("_at")).agg(
        F.count("_label").alias("_n"), F.sum("_label").alias("_sum")
    )
    earlier = W.partitionBy("_of").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    before = slots.select(
        "_of", "_at",
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_sum")],
    )
    met = rows.join(before, F.col("_value").eqNullSafe(F.col("_of")) & (F.col("_slot") == F.col("_at")))
    inside = W.partitionBy("_value", "_slot").orderBy("_place").rangeBetween(W.unboundedPreceding, -1)
    count = F.col("_n_before") + F.count("_label").over(inside)
    total = F.col("_sum_before") + F.coalesce(F.sum("_label").over(inside), F.lit(0.0))
    mean = F.lit(totals["mean"]).cast("double")
    return met.select("_row", ((total + prior * mean) / (count + prior)).alias(to)).select("_row.*", to)


def with_history(events: DataFrame, train: DataFrame) -> DataFrame:
    """Event rows with user history, inferred price and category popularity, gaps filled."""
    prices, popularity = inferred_prices(train), category_popularity(train)
    result = attach(
        events,
        popularity,
        "category_id",
        {"category_popularity": popularity.agg(F.avg("category_popularity")).scalar()},
    )
    result = attach(
        result,
        prices,
        "product_id",
        {"inferred_price": prices.agg(F.avg("inferred_price")).scalar()},
    )
    return attach(
        result,
        user_history(train),
        "user_id",
        {"user_avg_session_value": label_mean(train), "user_session_count": 0, "user_buy_count": 0},
    )


def group_counts(events: DataFrame) -> dict[str, DataFrame]:
    """One aggregation per key for everything the event rows get from users, products, categories
    and sessions. Label means use labelled rows only."""
    labelled = F.when(F.col("split") == "train", F.col("session_value"))
    user = events.groupBy("user_id").agg(
        *[count_of(t).alias(f"user_{t.lower()}_count") for t in EVENT_TYPES],
        F.count("*").alias("user_total_activities"),
        F.countDistinct(KEY).alias("user_session_count"),
        F.countDistinct("product_id").alias("user_unique_products"),
        F.countDistinct("category_id").alias("user_unique_categories"),
    )
    sides = {"user_id": user}
    for name in ("product", "category"):
        sides[f"{name}_id"] = events.groupBy(f"{name}_id").agg(
            F.count("*").alias(f"{name}_popularity"),
            F.avg(labelled).alias(f"{name}_avg_session_value"),
            F.countDistinct("user_id").alias(f"{name}_unique_users"),
        )
    seconds = seconds_between(F.min("event_time"), F.max("event_time"))
    session = events.groupBy(KEY).agg(
        F.count("*").alias("session_activity_count"),
        F.countDistinct("product_id").alias("session_unique_products"),
        F.countDistinct("category_id").alias("session_unique_categories"),
        (seconds / 60).alias("session_duration_minutes"),
        *[count_of(t).alias(f"_{t}") for t in EVENT_TYPES],
    )
    sides[KEY] = session.withColumns(
        {
            f"session_{t.lower()}_ratio": plain_ratio(f"_{t}", "session_activity_count")
            for t in EVENT_TYPES
        }
    ).drop(*[f"_{t}" for t in EVENT_TYPES])
    return sides


def with_group_counts(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Event rows with the aggregates of their category, product, user and session."""
    sides = group_counts(events)
    result = events
    for key in keys or ["category_id", "product_id", "user_id", KEY]:
        result = attach(result, sides[key], key)
    return result


def frequency_session_stats(events: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, maximum, sum, spread and median per session of frequency-encoded columns.

    All columns go through one long form (session, column, value, count): one count, one join with
    the shares of the fitted rows, one aggregate back. The spread is summed around the mean. It and
    the median keep the distinct frequencies of one session, of which N rows can produce no more
    than about sqrt(2 N). Events without a session belong to none.
    """
    long = F.inline(
        F.array(
            *[
                F.struct(F.lit(i).alias("_c"), F.col(c).cast("string").alias("_v"))
                for i, c in enumerate(columns)
            ]
        )
    )
    seen = events.where(F.col(KEY).isNotNull()).select(KEY, long)
    seen = seen.groupBy(KEY, "_c", "_v").agg(F.count("*").alias("_n"))
    known = train.select(long).where(F.col("_v").isNotNull())
    known = known.groupBy("_c", "_v").agg(F.count("*").alias("_k"))
    shares = known.select("_c", "_v", (F.col("_k") / train.agg(F.count("*")).scalar()).alias("_x"))
    counted = (
        seen.join(shares, ["_c", "_v"], "left")
        .groupBy(KEY, "_c", F.coalesce("_x", F.lit(0.0)).alias("_x"))
        .agg(F.sum("_n").alias("_n"))
    )
    sums, stats = [], []
    for i, column in enumerate(columns):
        mine = F.col("_c") == i
        n, x = F.when(mine, F.col("_n")), F.when(mine, F.col("_x"))
        sums += [
            F.sum(n).alias(f"_n{i}"),
            F.sum(x * n).alias(f"_s{i}"),
            F.max(x).alias(f"_m{i}"),
            F.collect_list(F.when(mine, F.struct("_x", "_n"))).alias(f"_l{i}"),
            F.percentile(x, 0.5, F.coalesce(n, F.lit(0))).alias(f"_p{i}"),
        ]
        freq, mean = f"{column}_freq", F.col(f"_s{i}") / F.col(f"_n{i}")
        parts = F.transform(f"_l{i}", lambda e: e["_n"] * (e["_x"] - mean) * (e["_x"] - mean))
        off = F.aggregate(parts, F.lit(0.0), lambda a, e: a + e)
        stats += [
            mean.alias(f"{freq}_mean"),
            F.col(f"_m{i}").alias(f"{freq}_max"),
            F.col(f"_s{i}").alias(f"{freq}_sum"),
            F.sqrt(F.try_divide(off, F.col(f"_n{i}").cast("double") - 1)).alias(f"{freq}_std"),
            F.col(f"_p{i}").alias(f"{freq}_median"),
        ]
    return counted.groupBy(KEY).agg(*sums).select(KEY, *stats)
