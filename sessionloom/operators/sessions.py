"""Session tables: one row per session with counts, ratios, durations and behaviour flags.

Column names of the event log are those of ``sources.fixtures``. Where an aggregate has partial
sums it is taken straight from the events; distinct values, modes and weighted means go through
counts per (session, value) first, so that no session is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.fixed_values import EVENT_TYPES
from sessionloom.functions.moments import is_weekend, seconds_between
from sessionloom.functions.ratios import (
    cyclical,
    per_unit,
    plain_ratio,
    safe_ratio,
    smooth_ratio,
)
from sessionloom.operators.encode import codes, equal_width, one_hot
from sessionloom.operators.lookup import attach

KEY = "user_session"


def count_of(event_type: str) -> Column:
    return F.count_if(F.col("event_type") == event_type)


def first_value(column: str) -> Column:
    """First non-null value of a group in event order."""
    at = F.when(F.col(column).isNotNull(), F.struct("event_time", "event_id"))
    return F.min_by(column, at)


def duration(time: str = "event_time") -> Column:
    return seconds_between(F.min(time), F.max(time))


def basic_features(events: DataFrame, with_label: bool = True) -> DataFrame:
    """Distinct event types, products and categories, event count, first user and label."""
    aggs = [
        F.countDistinct("event_type").alias("unique_event_types"),
        F.countDistinct("product_id").alias("unique_products"),
        F.countDistinct("category_id").alias("unique_categories"),
        F.count("event_time").alias("event_count"),
        first_value("user_id").alias("user_id"),
    ]
    if with_label:
        aggs.append(first_value("session_value").alias("session_value"))
    return events.groupBy(KEY).agg(*aggs)


def main_value(df: DataFrame, key: str, column: str, to: str) -> DataFrame:
    """Most frequent value per key, the smallest one on a tie."""
    counts = df.where(F.col(column).isNotNull()).groupBy(key, column).agg(F.count("*").alias("_n"))
    best = F.min_by(column, F.struct(-F.col("_n"), F.col(column)))
    return counts.groupBy(key).agg(best.alias(to))


def event_type_counts(events: DataFrame, key: str = KEY, types: list[str] = EVENT_TYPES) -> DataFrame:
    """Events of each type per key, zero where a type does not occur."""
    return events.groupBy(key).agg(*[count_of(t).alias(t) for t in types])


def event_type_pivot(events: DataFrame, types: list[str], key: str = KEY) -> DataFrame:
    """The same counts as a pivot over given values."""
    return events.groupBy(key).pivot("event_type", types).count().na.fill(0)


def event_ratios(events: DataFrame, types: list[str] = EVENT_TYPES, key: str = KEY) -> DataFrame:
    """Share of each event type among the events of a session."""
    counted = events.groupBy(key).agg(
        F.count("event_type").alias("event_count"), *[count_of(t).alias(t) for t in types]
    )
    return counted.select(
        key, *[plain_ratio(t, "event_count").alias(f"session_{t.lower()}_ratio") for t in types]
    )


def advanced_features(
    events: DataFrame, fit_codes_on: DataFrame | None = None, with_label: bool = False
) -> DataFrame:
    """Diversity and per-product ratios, cyclical time and mean id codes per session.

    Codes are fitted once (by default on these events) and carried by counts per (session, value).
    """
    aggs = [
        F.count("event_type").alias("event_count"),
        F.countDistinct("event_type").alias("unique_event_types"),
        F.avg(F.hour("event_time")).alias("avg_hour"),
        duration().alias("session_length"),
        *[count_of(t).alias(t) for t in EVENT_TYPES],
    ]
    if with_label:
        aggs.append(first_value("session_value").alias("session_value"))
    result = events.groupBy(KEY).agg(*aggs)
    weekdays = events.select(KEY, F.weekday("event_time").alias("dayofweek"))
    weekdays = main_value(weekdays, KEY, "dayofweek", "dayofweek_mode")
    result = attach(result, weekdays, KEY, {"dayofweek_mode": -1})
    distinct_names = {"product_id": "unique_products", "category_id": "unique_categories"}
    for column in ("product_id", "category_id", "user_id"):
        counted = events.groupBy(KEY, column).agg(F.count("*").alias("_n"))
        coded = codes(counted, column, fit_on=fit_codes_on, to="_code")
        weighted = F.sum(F.col("_code") * F.col("_n")) / F.sum(
            F.when(F.col("_code").isNotNull(), F.col("_n"))
        )
        side = [weighted.alias(f"{column}_mean_code")]
        if column in distinct_names:
            side.append(F.count(column).alias(distinct_names[column]))
        result = attach(result, coded.groupBy(KEY).agg(*side), KEY)
    hour_sin, hour_cos = cyclical("avg_hour", 24)
    day_sin, day_cos = cyclical("dayofweek_mode", 7)
    return result.withColumns(
        {
            **{f"ratio_{t}": plain_ratio(t, "event_count") for t in EVENT_TYPES},
            "product_diversity": plain_ratio("unique_products", "event_count"),
            "category_diversity": plain_ratio("unique_categories", "event_count"),
            "session_length_log": F.log1p("session_length"),
            "view_per_product": plain_ratio("VIEW", "unique_products"),
            "addcart_per_product": plain_ratio("ADD_CART", "unique_products"),
            "purchase_per_product": plain_ratio("BUY", "unique_products"),
            "category_per_product": plain_ratio("unique_categories", "unique_products"),
            "events_per_unique_product": plain_ratio("event_count", "unique_products"),
            "hour_sin": hour_sin,
            "hour_cos": hour_cos,
            "dayofweek_sin": day_sin,
            "dayofweek_cos": day_cos,
        }
    )


def weighted_side_mean(
    events: DataFrame, column: str, side: DataFrame, value: str, missing: Column, to: str
) -> DataFrame:
    """Mean over a session's events of a side-table value, with the count of distinct keys.

    The side table meets one row per (session, key) instead of every event.
    """
    counted = events.groupBy(KEY, column).agg(F.count("*").alias("_n"))
    joined = attach(counted, side, column, {value: missing})
    return joined.groupBy(KEY).agg(
        (F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias(to),
        F.count(column).alias(f"unique_{column}"),
        F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias(f"main_{column}"),
    )


def rich_features(
    events: DataFrame, users: DataFrame, prices: DataFrame, popularity: DataFrame,
    label_mean: Column,
) -> DataFrame:
    """Session table with counts, duration, mean inferred price, mean category popularity, main
    category and the user's history.

    ``users``, ``prices`` and ``popularity`` come from ``operators.history``; sessions without a
    match use the overall means.
    """
    result = events.groupBy(KEY).agg(
        count_of("VIEW").alias("views"),
        count_of("ADD_CART").alias("add_to_carts"),
        count_of("REMOVE_CART").alias("removals_from_cart"),
        count_of("BUY").alias("buys"),
        duration().alias("session_duration_seconds"),
        F.max(is_weekend("event_time")).alias("is_weekend"),
        F.count("event_time").alias("total_events"),
        first_value("user_id").alias("user_id"),
        F.avg("session_value").alias("session_value"),
    )
    mean_price = prices.agg(F.avg("inferred_price")).scalar()
    priced = weighted_side_mean(
        events, "product_id", prices, "inferred_price", mean_price, "avg_inferred_price"
    ).select(KEY, "avg_inferred_price", F.col("unique_product_id").alias("unique_products"))
    mean_popularity = popularity.agg(F.avg("category_popularity")).scalar()
    popular = weighted_side_mean(
        events, "category_id", popularity, "category_popularity", mean_popularity,
        "avg_category_popularity",
    ).select(KEY, "avg_category_popularity", F.col("main_category_id").alias("main_category"))
    result = attach(attach(result, priced, KEY), popular, KEY)
    return attach(
        result,
        users,
        "user_id",
        {"user_avg_session_value": label_mean, "user_session_count": 0, "user_buy_count": 0},
    )


def behavior_features(sessions: DataFrame, ratios: str = "smooth") -> DataFrame:
    """Conversion ratios, cart behaviour, user flags and activity of a rich session table."""
    ratio = {"smooth": smooth_ratio, "safe": safe_ratio}[ratios]
    counts = ["views", "add_to_carts", "removals_from_cart", "buys"]
    kinds = [(F.col(c) > 0).cast("int") for c in counts]
    return sessions.withColumns(
        {
            "view_to_cart_ratio": ratio("add_to_carts", "views"),
            "cart_to_buy_ratio": ratio("buys", "add_to_carts"),
            "view_to_buy_ratio": ratio("buys", "views"),
            "removal_to_add_ratio": ratio("removals_from_cart", "add_to_carts"),
            "net_cart_adds": F.col("add_to_carts") - F.col("removals_from_cart"),
            "is_cart_abandoned": ((F.col("add_to_carts") > 0) & (F.col("buys") == 0)).cast("int"),
            "is_new_user": (F.col("user_session_count") <= 1).cast("int"),
            "is_frequent_buyer": (F.col("user_buy_count") >= 3).cast("int"),
            "interaction_diversity": kinds[0] + kinds[1] + kinds[2] + kinds[3],
        }
    )


def density_features(sessions: DataFrame, mean_popularity: Column) -> DataFrame:
    """Events per minute and second, price sensitivity, category preference."""
    seconds = "session_duration_seconds"
    return sessions.withColumns(
        {
            "events_per_minute": F.col("total_events") / (F.col(seconds) / 60 + 1),
            "event_density": per_unit("total_events", seconds),
            "prod_per_sec": per_unit("unique_products", seconds),
            "cart_per_view": per_unit("add_to_carts", "views"),
            "price_sensitivity": smooth_ratio("avg_inferred_price", "user_avg_session_value"),
            "category_preference_strength": plain_ratio("avg_category_popularity", mean_popularity),
        }
    )


def value_segments(sessions: DataFrame) -> DataFrame:
    """Low, medium or high user value as three 0/1 columns."""
    labels = ["low", "medium", "high"]
    cut = equal_width(sessions, "user_avg_session_value", labels, "user_value_segment")
    return one_hot(cut, "user_value_segment", labels, "segment")


def mean_per_key(df: DataFrame, value: str, key: str = KEY, to: str | None = None) -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias(to or value))
