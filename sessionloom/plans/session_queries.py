"""Queries on sessions, time, ids, history and event rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.functions.fixed_values import EVENT_TYPES, WEEKDAYS
from sessionloom.functions.moments import day_part, time_features
from sessionloom.functions.ratios import money_mean, money_sum, round_even
from sessionloom.functions.texts import id_number, id_suffix
from sessionloom.operators import history, sessions
from sessionloom.operators.columns import one_row_per, stack_parts
from sessionloom.operators.lookup import attach
from sessionloom.plans.common import rounded, sql_rounded, test_part, train_part
from sessionloom.plans.registry import query
from sessionloom.sources.fixtures import (
    BASKETS_SQL,
    EVENTS_SQL,
    baskets,
    session_events,
    staged_events,
    table,
)

KEY = "user_session"
ALL_TYPES = [*EVENT_TYPES, "OTHER"]


@query(
    "session_basic_features",
    EVENTS_SQL
    + """
SELECT user_session, count(DISTINCT event_type) AS unique_event_types,
       count(DISTINCT product_id) AS unique_products,
       count(DISTINCT category_id) AS unique_categories, count(event_time) AS event_count,
       arg_min(user_id, (event_time, event_id)) AS user_id,
       arg_min(session_value, (event_time, event_id)) AS session_value
FROM ev GROUP BY user_session""",
)
def session_basic_features(spark, folder):
    return sessions.basic_features(session_events(spark, folder))


@query(
    "session_min_max_mean",
    EVENTS_SQL
    + f"""
SELECT user_session, {sql_rounded(["value_min", "value_max", "value_mean", "value_sum"])}
FROM (SELECT user_session, min(value) AS value_min, max(value) AS value_max,
             avg(value) AS value_mean, sum(value) AS value_sum FROM ev GROUP BY user_session)""",
)
def session_min_max_mean(spark, folder):
    events = session_events(spark, folder)
    aggs = [f("value").alias(f"value_{n}") for n, f in
            (("min", F.min), ("max", F.max), ("mean", F.avg), ("sum", F.sum))]
    return rounded(events.groupBy(KEY).agg(*aggs))


@query(
    "session_duration",
    EVENTS_SQL
    + """
SELECT user_session, min(event_time) AS session_start, max(event_time) AS session_end,
       round(date_diff('microsecond', min(event_time), max(event_time)) / 1e6 + 3e-9, 6)
         AS duration_seconds
FROM ev GROUP BY user_session""",
)
def session_duration(spark, folder):
    return rounded(
        session_events(spark, folder)
        .groupBy(KEY)
        .agg(
            F.min("event_time").alias("session_start"),
            F.max("event_time").alias("session_end"),
            sessions.duration().alias("duration_seconds"),
        )
    )


@query(
    "session_main_category",
    EVENTS_SQL
    + """
SELECT user_session, category_id AS main_category
FROM (SELECT user_session, category_id,
             row_number() OVER (PARTITION BY user_session ORDER BY count(*) DESC, category_id) AS r
      FROM ev GROUP BY user_session, category_id)
WHERE r = 1""",
)
def session_main_category(spark, folder):
    return sessions.main_value(session_events(spark, folder), KEY, "category_id", "main_category")


PIVOT_SQL = ", ".join(f"""count(*) FILTER (event_type = '{t}') AS "{t}" """ for t in ALL_TYPES)


@query(
    "session_event_pivot",
    EVENTS_SQL + f"SELECT user_session, {PIVOT_SQL} FROM ev GROUP BY user_session",
)
def session_event_pivot(spark, folder):
    return sessions.event_type_pivot(session_events(spark, folder), ALL_TYPES)


@query(
    "session_event_counts",
    EVENTS_SQL + f"SELECT user_session, {PIVOT_SQL} FROM ev GROUP BY user_session",
)
def session_event_counts(spark, folder):
    return sessions.event_type_counts(session_events(spark, folder), types=ALL_TYPES)


@query(
    "session_event_ratios",
    EVENTS_SQL
    + "SELECT user_session, "
    + ", ".join(
        f"round(count(*) FILTER (event_type = '{t}') / count(event_type) + 3e-9, 6)"
        f" AS session_{t.lower()}_ratio"
        for t in EVENT_TYPES
    )
    + " FROM ev GROUP BY user_session",
)
def session_event_ratios(spark, folder):
    return rounded(sessions.event_ratios(session_events(spark, folder)))


DAY_PART_SQL = {
    "right_closed": "CASE WHEN h <= 6 THEN 'gece' WHEN h <= 12 THEN 'sabah'"
    " WHEN h <= 18 THEN 'oglen' ELSE 'aksam' END",
    "left_closed": "CASE WHEN h < 6 THEN 3 WHEN h < 12 THEN 0 WHEN h < 18 THEN 1 ELSE 2 END",
    "named": "CASE WHEN h >= 6 AND h < 12 THEN 'morning' WHEN h >= 12 AND h < 18 THEN 'afternoon'"
    " WHEN h >= 18 AND h < 22 THEN 'evening' ELSE 'night' END",
    "shifted": "CASE WHEN h >= 5 AND h < 12 THEN 0 WHEN h >= 12 AND h < 17 THEN 1"
    " WHEN h >= 17 AND h < 21 THEN 2 ELSE 3 END",
}


@query(
    "event_time_features",
    f"""
SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
       CAST(day(ts) AS INTEGER) AS day, CAST(month(ts) AS INTEGER) AS month,
       CAST(year(ts) AS INTEGER) AS year, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend,
       {DAY_PART_SQL["right_closed"]} AS time_period
FROM (SELECT *, hour(ts) AS h FROM events)""",
)
def event_time_features(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts")
    return time_features(events, "ts").drop("ts")


for letter, preset in zip("abcd", DAY_PART_SQL):

    @query(
        f"day_part_{letter}",
        f"SELECT event_id, {DAY_PART_SQL[preset]} AS day_part"
        " FROM (SELECT event_id, hour(ts) AS h FROM events)",
    )
    def day_part_query(spark, folder, preset=preset):
        events = table(spark, folder, "events")
        return events.select("event_id", day_part(F.hour("ts"), preset).alias("day_part"))


@query(
    "id_parts",
    EVENTS_SQL
    + """
SELECT 'event ' || event_id AS row_name, split_part(product_id, '_', 2) AS suffix,
       CAST(regexp_extract(user_session, '(\\d+)', 1) AS BIGINT) AS number
FROM ev
UNION ALL
SELECT c_name, NULL, CAST(regexp_extract(c_name, '(\\d+)', 1) AS BIGINT) FROM customer""",
)
def id_parts(spark, folder):
    events = session_events(spark, folder).select(
        F.concat_ws(" ", F.lit("event"), "event_id").alias("row_name"),
        id_suffix("product_id").alias("suffix"),
        id_number(KEY).alias("number"),
    )
    customers = table(spark, folder, "customer").select(
        F.col("c_name").alias("row_name"),
        id_suffix("c_name").alias("suffix"),
        id_number("c_name").alias("number"),
    )
    return events.unionByName(customers)


@query(
    "proxy_features",
    EVENTS_SQL
    + """
SELECT event_id, max(p) OVER () - p AS product_age_proxy, user_id % 100 AS user_activity_proxy,
       s % 1000 AS session_activity_proxy
FROM (SELECT *, CAST(regexp_extract(product_id, '(\\d+)', 1) AS BIGINT) AS p,
             CAST(regexp_extract(user_session, '(\\d+)', 1) AS BIGINT) AS s FROM ev)""",
)
def proxy_features(spark, folder):
    events = session_events(spark, folder)
    products = table(spark, folder, "events").select(
        F.get_json_object("props", "$.k").cast("bigint").alias("p")
    )
    newest = products.agg(F.max("p")).scalar()
    return events.select(
        "event_id",
        (newest - id_number("product_id")).alias("product_age_proxy"),
        (F.col("user_id") % 100).alias("user_activity_proxy"),
        (id_number(KEY) % 1000).alias("session_activity_proxy"),
    )


USERS_SQL = """
SELECT user_id, avg(session_value) AS user_avg_session_value,
       count(DISTINCT user_session) AS user_session_count,
       count(*) FILTER (event_type = 'BUY') AS user_buy_count
FROM ev WHERE split = 'train' GROUP BY user_id"""
PRICES_SQL = """
SELECT product_id, avg(session_value) AS inferred_price
FROM ev WHERE split = 'train' AND event_type = 'BUY' GROUP BY product_id"""
POPULARITY_SQL = """
SELECT category_id, count(*) AS category_popularity
FROM ev WHERE split = 'train' AND event_type = 'BUY' GROUP BY category_id"""
SIDES_SQL = (
    f", users AS ({USERS_SQL}), prices AS ({PRICES_SQL}), popularity AS ({POPULARITY_SQL})"
)


@query(
    "user_history",
    EVENTS_SQL
    + f"""
SELECT user_id, round(user_avg_session_value + 3e-9, 6) AS user_avg_session_value, user_session_count,
       user_buy_count
FROM ({USERS_SQL})""",
)
def user_history(spark, folder):
    return rounded(history.user_history(train_part(session_events(spark, folder))))


@query(
    "inferred_price",
    EVENTS_SQL
    + f"SELECT product_id, round(inferred_price + 3e-9, 6) AS inferred_price FROM ({PRICES_SQL})",
)
def inferred_price(spark, folder):
    return rounded(history.inferred_prices(train_part(session_events(spark, folder))))


@query("category_popularity", EVENTS_SQL + POPULARITY_SQL)
def category_popularity(spark, folder):
    return history.category_popularity(train_part(session_events(spark, folder)))


@query(
    "global_means",
    EVENTS_SQL
    + SIDES_SQL
    + """
SELECT round((SELECT avg(inferred_price) FROM prices) + 3e-9, 6) AS global_mean_price,
       round((SELECT avg(category_popularity) FROM popularity) + 3e-9, 6) AS global_mean_popularity,
       round((SELECT avg(session_value) FROM ev WHERE split = 'train') + 3e-9, 6) AS label_mean""",
)
def global_means(spark, folder):
    train = train_part(staged_events(spark, folder))
    prices = history.inferred_prices(train).agg(F.avg("inferred_price"))
    popularity = history.category_popularity(train).agg(F.avg("category_popularity"))
    return rounded(
        train.agg(F.avg("session_value").alias("label_mean")).select(
            prices.scalar().alias("global_mean_price"),
            popularity.scalar().alias("global_mean_popularity"),
            "label_mean",
        )
    )


@query(
    "event_rows_with_history",
    EVENTS_SQL
    + SIDES_SQL
    + """
SELECT event_id, split,
  round(coalesce(user_avg_session_value,
        (SELECT avg(session_value) FROM ev WHERE split = 'train')) + 3e-9, 6) AS user_avg_session_value,
  coalesce(user_session_count, 0) AS user_session_count,
  coalesce(user_buy_count, 0) AS user_buy_count,
  round(coalesce(inferred_price, (SELECT avg(inferred_price) FROM prices)) + 3e-9, 6) AS inferred_price,
  round(coalesce(category_popularity, (SELECT avg(category_popularity) FROM popularity)) + 3e-9, 6)
    AS category_popularity
FROM ev LEFT JOIN users USING (user_id) LEFT JOIN prices USING (product_id)
  LEFT JOIN popularity USING (category_id)""",
)
def event_rows_with_history(spark, folder):
    events = staged_events(spark, folder)
    train = train_part(events).drop("split")
    both = stack_parts(
        {"train": train, "test": test_part(events).drop("split", "session_value")}
    )
    result = history.with_history(both, train_part(events))
    return rounded(
        result.select(
            "event_id", "split", "user_avg_session_value", "user_session_count", "user_buy_count",
            "inferred_price", F.col("category_popularity").cast("double").alias("category_popularity"),
        )
    )


USER_COUNTS_SQL = ", ".join(
    f"count(*) FILTER (event_type = '{t}') AS user_{t.lower()}_count" for t in EVENT_TYPES
)
SESSION_RATIOS_SQL = ", ".join(
    f"count(*) FILTER (event_type = '{t}') / count(*) AS session_{t.lower()}_ratio"
    for t in EVENT_TYPES
)
GROUPS_SQL = f""",
u AS (SELECT user_id, {USER_COUNTS_SQL}, count(*) AS user_total_activities,
        count(DISTINCT user_session) AS user_session_count,
        count(DISTINCT product_id) AS user_unique_products,
        count(DISTINCT category_id) AS user_unique_categories FROM ev GROUP BY user_id),
p AS (SELECT product_id, count(*) AS product_popularity,
        avg(session_value) FILTER (split = 'train') AS product_avg_session_value,
        count(DISTINCT user_id) AS product_unique_users FROM ev GROUP BY product_id),
c AS (SELECT category_id, count(*) AS category_popularity,
        avg(session_value) FILTER (split = 'train') AS category_avg_session_value,
        count(DISTINCT user_id) AS category_unique_users FROM ev GROUP BY category_id),
s AS (SELECT user_session, count(*) AS session_activity_count,
        count(DISTINCT product_id) AS session_unique_products,
        count(DISTINCT category_id) AS session_unique_categories,
        date_diff('microsecond', min(event_time), max(event_time)) / 1e6 / 60
          AS session_duration_minutes,
        {SESSION_RATIOS_SQL} FROM ev GROUP BY user_session)"""
GROUP_COLUMNS = [
    *[f"user_{t.lower()}_count" for t in EVENT_TYPES],
    "user_total_activities", "user_session_count", "user_unique_products",
    "user_unique_categories", "product_popularity", "product_unique_users",
    "category_popularity", "category_unique_users", "session_activity_count",
    "session_unique_products", "session_unique_categories",
]
GROUP_NUMBERS = [
    "product_avg_session_value", "category_avg_session_value", "session_duration_minutes",
    *[f"session_{t.lower()}_ratio" for t in EVENT_TYPES],
]


@query(
    "rows_with_group_counts",
    EVENTS_SQL
    + GROUPS_SQL
    + f"""
SELECT event_id, {", ".join(GROUP_COLUMNS)}, {sql_rounded(GROUP_NUMBERS)}
FROM ev LEFT JOIN u USING (user_id) LEFT JOIN p USING (product_id)
  LEFT JOIN c USING (category_id) LEFT JOIN s USING (user_session)""",
)
def rows_with_group_counts(spark, folder):
    result = history.with_group_counts(staged_events(spark, folder))
    return rounded(result.select("event_id", *GROUP_COLUMNS, *GROUP_NUMBERS))


@query(
    "rows_with_session_features",
    EVENTS_SQL
    + """, s AS (
SELECT user_session, count(event_time) AS event_count,
       count(DISTINCT product_id) AS unique_products FROM ev GROUP BY user_session)
SELECT event_id, user_session, event_count, unique_products FROM ev JOIN s USING (user_session)""",
)
def rows_with_session_features(spark, folder):
    events = staged_events(spark, folder)
    per_session = sessions.basic_features(events).select(KEY, "event_count", "unique_products")
    return attach(events.select("event_id", KEY), per_session, KEY)


ADVANCED_NUMBERS = [
    "avg_hour", "session_length", *[f"ratio_{t}" for t in EVENT_TYPES], "product_diversity",
    "category_diversity", "session_length_log", "view_per_product", "addcart_per_product",
    "purchase_per_product", "category_per_product", "events_per_unique_product", "hour_sin",
    "hour_cos", "dayofweek_sin", "dayofweek_cos", "product_id_mean_code", "category_id_mean_code",
    "user_id_mean_code",
]
ADVANCED_SQL = """,
dow AS (
  SELECT user_session, d FROM (
    SELECT user_session, d, row_number() OVER (PARTITION BY user_session ORDER BY count(*) DESC, d)
             AS r
    FROM (SELECT user_session, isodow(event_time) - 1 AS d FROM ev) GROUP BY user_session, d)
  WHERE r = 1),
coded AS (
  SELECT *, dense_rank() OVER (ORDER BY product_id) - 1 AS pc,
         dense_rank() OVER (ORDER BY category_id) - 1 AS cc,
         dense_rank() OVER (ORDER BY user_id) - 1 AS uc FROM ev),
base AS (
  SELECT user_session, count(event_type) AS event_count,
         count(DISTINCT event_type) AS unique_event_types,
         count(DISTINCT product_id) AS unique_products,
         count(DISTINCT category_id) AS unique_categories, avg(hour(event_time)) AS avg_hour,
         date_diff('microsecond', min(event_time), max(event_time)) / 1e6 AS session_length,
         count(*) FILTER (event_type = 'VIEW') AS nv,
         count(*) FILTER (event_type = 'ADD_CART') AS na,
         count(*) FILTER (event_type = 'REMOVE_CART') AS nr,
         count(*) FILTER (event_type = 'BUY') AS nb,
         avg(pc) AS product_id_mean_code, avg(cc) AS category_id_mean_code,
         avg(uc) AS user_id_mean_code
  FROM coded GROUP BY user_session),
adv AS (
  SELECT *, nv / event_count AS "ratio_VIEW", na / event_count AS "ratio_ADD_CART",
         nr / event_count AS "ratio_REMOVE_CART", nb / event_count AS "ratio_BUY",
         unique_products / event_count AS product_diversity,
         unique_categories / event_count AS category_diversity,
         ln(1 + session_length) AS session_length_log, nv / unique_products AS view_per_product,
         na / unique_products AS addcart_per_product, nb / unique_products AS purchase_per_product,
         unique_categories / unique_products AS category_per_product,
         event_count / unique_products AS events_per_unique_product,
         sin(2 * pi() * avg_hour / 24) AS hour_sin, cos(2 * pi() * avg_hour / 24) AS hour_cos,
         sin(2 * pi() * d / 7) AS dayofweek_sin, cos(2 * pi() * d / 7) AS dayofweek_cos
  FROM base JOIN dow USING (user_session))"""


@query(
    "session_advanced_features",
    EVENTS_SQL
    + ADVANCED_SQL
    + f"""
SELECT user_session, event_count, unique_event_types, unique_products, unique_categories,
       CAST(d AS INTEGER) AS dayofweek_mode, {sql_rounded(ADVANCED_NUMBERS)} FROM adv""",
)
def session_advanced_features(spark, folder):
    result = sessions.advanced_features(staged_events(spark, folder))
    return rounded(
        result.select(
            KEY, "event_count", "unique_event_types", "unique_products", "unique_categories",
            "dayofweek_mode", *ADVANCED_NUMBERS,
        )
    )


RICH_SQL = (
    SIDES_SQL
    + """,
main AS (
  SELECT user_session, category_id AS main_category FROM (
    SELECT user_session, category_id,
           row_number() OVER (PARTITION BY user_session ORDER BY count(*) DESC, category_id) AS r
    FROM ev GROUP BY user_session, category_id) WHERE r = 1),
rich AS (
  SELECT user_session, count(*) FILTER (event_type = 'VIEW') AS views,
    count(*) FILTER (event_type = 'ADD_CART') AS add_to_carts,
    count(*) FILTER (event_type = 'REMOVE_CART') AS removals_from_cart,
    count(*) FILTER (event_type = 'BUY') AS buys,
    date_diff('microsecond', min(event_time), max(event_time)) / 1e6 AS session_duration_seconds,
    avg(coalesce(inferred_price, (SELECT avg(inferred_price) FROM prices))) AS avg_inferred_price,
    max(CAST(isodow(event_time) >= 6 AS INTEGER)) AS is_weekend,
    max(coalesce(user_avg_session_value,
                 (SELECT avg(session_value) FROM ev WHERE split = 'train')))
      AS user_avg_session_value,
    max(coalesce(user_session_count, 0)) AS user_session_count,
    max(coalesce(user_buy_count, 0)) AS user_buy_count,
    avg(coalesce(category_popularity, (SELECT avg(category_popularity) FROM popularity)))
      AS avg_category_popularity,
    count(DISTINCT product_id) AS unique_products, count(event_time) AS total_events,
    avg(session_value) AS session_value
  FROM ev LEFT JOIN users USING (user_id) LEFT JOIN prices USING (product_id)
    LEFT JOIN popularity USING (category_id)
  GROUP BY user_session)"""
)
RICH_COUNTS = [
    "views", "add_to_carts", "removals_from_cart", "buys", "is_weekend", "user_session_count",
    "user_buy_count", "unique_products", "total_events",
]
RICH_NUMBERS = [
    "session_duration_seconds", "avg_inferred_price", "user_avg_session_value",
    "avg_category_popularity", "session_value",
]


def rich(events, train=None):
    train = train_part(events) if train is None else train
    return sessions.rich_features(
        events,
        history.user_history(train),
        history.inferred_prices(train),
        history.category_popularity(train),
        history.label_mean(train),
    )


@query(
    "session_rich_features",
    EVENTS_SQL
    + RICH_SQL
    + f"""
SELECT user_session, main_category, {", ".join(RICH_COUNTS)}, {sql_rounded(RICH_NUMBERS)}
FROM rich JOIN main USING (user_session)""",
)
def session_rich_features(spark, folder):
    result = rich(staged_events(spark, folder))
    return rounded(result.select(KEY, "main_category", *RICH_COUNTS, *RICH_NUMBERS))


BEHAVIOR_FLAGS = [
    "net_cart_adds", "is_cart_abandoned", "is_new_user", "is_frequent_buyer",
    "interaction_diversity",
]
BEHAVIOR_RATIOS = [
    "view_to_cart_ratio", "cart_to_buy_ratio", "view_to_buy_ratio", "removal_to_add_ratio",
]
BEHAVIOR_SQL = """
  add_to_carts - removals_from_cart AS net_cart_adds,
  CAST(add_to_carts > 0 AND buys = 0 AS INTEGER) AS is_cart_abandoned,
  CAST(user_session_count <= 1 AS INTEGER) AS is_new_user,
  CAST(user_buy_count >= 3 AS INTEGER) AS is_frequent_buyer,
  CAST(views > 0 AS INTEGER) + CAST(add_to_carts > 0 AS INTEGER)
    + CAST(removals_from_cart > 0 AS INTEGER) + CAST(buys > 0 AS INTEGER) AS interaction_diversity"""
SMOOTH_SQL = """
  add_to_carts / (views + 1) AS view_to_cart_ratio, buys / (add_to_carts + 1) AS cart_to_buy_ratio,
  buys / (views + 1) AS view_to_buy_ratio,
  removals_from_cart / (add_to_carts + 1) AS removal_to_add_ratio"""
SAFE_SQL = """
  coalesce(add_to_carts / nullif(views, 0), 0) AS view_to_cart_ratio,
  coalesce(buys / nullif(add_to_carts, 0), 0) AS cart_to_buy_ratio,
  coalesce(buys / nullif(views, 0), 0) AS view_to_buy_ratio,
  coalesce(removals_from_cart / nullif(add_to_carts, 0), 0) AS removal_to_add_ratio"""
SEGMENT_SQL = """
  CASE WHEN mx = mn THEN 2
       ELSE greatest(1, least(3, ceil((user_avg_session_value - mn) * 3 / (mx - mn)))) END AS seg
  FROM (SELECT *, min(user_avg_session_value) OVER () AS mn,
               max(user_avg_session_value) OVER () AS mx FROM rich)"""


@query(
    "session_behavior_features",
    EVENTS_SQL
    + RICH_SQL
    + f"""
SELECT user_session, {", ".join(BEHAVIOR_FLAGS)}, {sql_rounded(BEHAVIOR_RATIOS)},
       CAST(seg = 1 AS INTEGER) AS segment_low, CAST(seg = 2 AS INTEGER) AS segment_medium,
       CAST(seg = 3 AS INTEGER) AS segment_high
FROM (SELECT *, {BEHAVIOR_SQL}, {SMOOTH_SQL}, {SEGMENT_SQL})""",
)
def session_behavior_features(spark, folder):
    result = sessions.behavior_features(rich(staged_events(spark, folder)))
    result = sessions.value_segments(result)
    segments = ["segment_low", "segment_medium", "segment_high"]
    return rounded(result.select(KEY, *BEHAVIOR_FLAGS, *BEHAVIOR_RATIOS, *segments))


@query(
    "session_safe_ratios",
    EVENTS_SQL
    + RICH_SQL
    + f"SELECT user_session, {sql_rounded(BEHAVIOR_RATIOS)} FROM (SELECT *, {SAFE_SQL} FROM rich)",
)
def session_safe_ratios(spark, folder):
    counts = session_events(spark, folder).groupBy(KEY).agg(
        sessions.count_of("VIEW").alias("views"),
        sessions.count_of("ADD_CART").alias("add_to_carts"),
        sessions.count_of("REMOVE_CART").alias("removals_from_cart"),
        sessions.count_of("BUY").alias("buys"),
        F.lit(0).alias("user_session_count"),
        F.lit(0).alias("user_buy_count"),
    )
    return rounded(sessions.behavior_features(counts, "safe").select(KEY, *BEHAVIOR_RATIOS))


DENSITIES = [
    "events_per_minute", "event_density", "prod_per_sec", "cart_per_view", "price_sensitivity",
    "category_preference_strength",
]


@query(
    "session_densities",
    EVENTS_SQL
    + RICH_SQL
    + f"""
SELECT user_session, {sql_rounded(DENSITIES)} FROM (
  SELECT user_session, total_events / (session_duration_seconds / 60 + 1) AS events_per_minute,
    total_events / CASE WHEN session_duration_seconds = 0 THEN 1 ELSE session_duration_seconds END
      AS event_density,
    unique_products / CASE WHEN session_duration_seconds = 0 THEN 1
                           ELSE session_duration_seconds END AS prod_per_sec,
    add_to_carts / CASE WHEN views = 0 THEN 1 ELSE views END AS cart_per_view,
    avg_inferred_price / (user_avg_session_value + 1) AS price_sensitivity,
    avg_category_popularity / (SELECT avg(category_popularity) FROM popularity)
      AS category_preference_strength
  FROM rich)""",
)
def session_densities(spark, folder):
    events = staged_events(spark, folder)
    popularity = history.category_popularity(train_part(events))
    mean = popularity.agg(F.avg("category_popularity")).scalar()
    return rounded(sessions.density_features(rich(events), mean).select(KEY, *DENSITIES))


FREQ_COLUMNS = ["event_type", "product_id", "category_id", "user_id"]
FREQ_CTES = "".join(
    f""",
f_{c} AS (SELECT {c}, count(*) / (SELECT count(*) FROM ev WHERE split = 'train') AS {c}_freq
          FROM ev WHERE split = 'train' GROUP BY {c})"""
    for c in FREQ_COLUMNS
)
FREQ_ROWS_SQL = (
    FREQ_CTES
    + ", fr AS (SELECT event_id, user_session, "
    + ", ".join(f"coalesce({c}_freq, 0) AS {c}_freq" for c in FREQ_COLUMNS)
    + " FROM ev "
    + " ".join(f"LEFT JOIN f_{c} USING ({c})" for c in FREQ_COLUMNS)
    + ")"
)


@query(
    "frequency_encoding",
    EVENTS_SQL
    + FREQ_ROWS_SQL
    + f"SELECT event_id, {sql_rounded([f'{c}_freq' for c in FREQ_COLUMNS])} FROM fr",
)
def frequency_encoding(spark, folder):
    from sessionloom.operators.encode import frequency_encode

    events = staged_events(spark, folder).select("event_id", "split", *FREQ_COLUMNS)
    train = train_part(events)
    result = events
    for column in FREQ_COLUMNS:
        result = frequency_encode(result, column, train)
    return rounded(result.select("event_id", *[f"{c}_freq" for c in FREQ_COLUMNS]))


FREQ_STATS = {"mean": "avg", "max": "max", "sum": "sum", "std": "stddev_samp", "median": "median"}


@query(
    "frequency_session_stats",
    EVENTS_SQL
    + FREQ_ROWS_SQL
    + "SELECT user_session, "
    + ", ".join(
        f"round({fn}({c}_freq) + 3e-9, 6) AS {c}_freq_{name}"
        for c in FREQ_COLUMNS
        for name, fn in FREQ_STATS.items()
    )
    + " FROM fr GROUP BY user_session",
)
def frequency_session_stats(spark, folder):
    events = staged_events(spark, folder)
    return rounded(history.frequency_session_stats(events, train_part(events), FREQ_COLUMNS))


@query(
    "target_mean_encoding",
    EVENTS_SQL
    + """
SELECT event_id, round(pm + 3e-9, 6) AS product_avg_session_value, round(cm + 3e-9, 6)
       AS category_avg_session_value
FROM ev LEFT JOIN (SELECT product_id, avg(session_value) AS pm FROM ev WHERE split = 'train'
                   GROUP BY product_id) USING (product_id)
        LEFT JOIN (SELECT category_id, avg(session_value) AS cm FROM ev WHERE split = 'train'
                   GROUP BY category_id) USING (category_id)""",
)
def target_mean_encoding(spark, folder):
    events = staged_events(spark, folder)
    train = train_part(events)
    result = events.select("event_id", "product_id", "category_id")
    for name in ("product", "category"):
        result = history.target_mean(
            result, f"{name}_id", "session_value", train, f"{name}_avg_session_value"
        )
    return rounded(result.drop("product_id", "category_id"))


@query(
    "label_per_session",
    EVENTS_SQL
    + """
SELECT user_session, count(*) AS event_count, max(session_value) AS session_value
FROM ev GROUP BY user_session""",
)
def label_per_session(spark, folder):
    events = staged_events(spark, folder)
    counts = events.groupBy(KEY).agg(F.count("*").alias("event_count"))
    labels = one_row_per(events, KEY, "session_value", ["event_time", "event_id"])
    return attach(counts, labels, KEY)


@query("distinct_labels", EVENTS_SQL + "SELECT DISTINCT user_session, session_value FROM ev")
def distinct_labels(spark, folder):
    return session_events(spark, folder).select(KEY, "session_value").distinct()


@query("distinct_categories", EVENTS_SQL + "SELECT DISTINCT category_id FROM ev")
def distinct_categories(spark, folder):
    return session_events(spark, folder).select("category_id").distinct()


MONEY_SQL = (
    "CAST(sum(CAST(session_value AS DECIMAL(18,2))) AS DOUBLE) / count(session_value)"
)


@query(
    "hourly_target_stats",
    EVENTS_SQL
    + f"""
SELECT * FROM (
SELECT 'hour' AS kind, CAST(hour(event_time) AS VARCHAR) AS name,
       round_even({MONEY_SQL}, 2) AS mean, count(session_value) AS count
FROM ev WHERE split = 'train' GROUP BY 2
UNION ALL
SELECT 'weekday', {WEEKDAYS}[isodow(event_time)], round_even({MONEY_SQL}, 2),
       count(session_value) FROM ev WHERE split = 'train' GROUP BY 2
UNION ALL
SELECT 'category', category_id, round_even({MONEY_SQL}, 2), count(session_value)
FROM ev WHERE split = 'train' GROUP BY 2)""",
)
def hourly_target_stats(spark, folder):
    train = train_part(session_events(spark, folder))
    names = F.array(*[F.lit(n) for n in WEEKDAYS])
    kinds = {
        "hour": F.hour("event_time").cast("string"),
        "weekday": F.try_element_at(names, F.weekday("event_time") + 1),
        "category": F.col("category_id"),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("name")) for k, v in kinds.items()])
    rows = train.select(F.explode(pairs).alias("group"), "session_value")
    return rows.groupBy("group.kind", "group.name").agg(
        round_even(money_mean("session_value"), 2).alias("mean"), F.count("session_value").alias("count")
    )


@query(
    "session_multi_agg",
    EVENTS_SQL
    + """
SELECT user_session,
       round_even(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value), 4) AS value_mean,
       round_even(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 4) AS value_sum,
       count(value) AS value_count, round_even(stddev_samp(value), 4) AS value_std
FROM ev GROUP BY user_session""",
)
def session_multi_agg(spark, folder):
    return session_events(spark, folder).groupBy(KEY).agg(
        round_even(money_mean("value"), 4).alias("value_mean"),
        round_even(money_sum("value"), 4).alias("value_sum"),
        F.count("value").alias("value_count"),
        round_even(F.stddev_samp("value"), 4).alias("value_std"),
    )


@query(
    "basket_features",
    BASKETS_SQL
    + """
SELECT user_session, count(DISTINCT event_type) AS unique_event_types,
       count(DISTINCT product_id) AS unique_products,
       count(DISTINCT category_id) AS unique_categories, count(*) AS event_count,
       max(user_id) AS user_id, max(session_value) AS session_value,
       date_diff('microsecond', min(event_time), max(event_time)) / 1e6 AS duration_seconds
FROM ev GROUP BY user_session""",
)
def basket_features(spark, folder):
    return baskets(spark, folder).groupBy(KEY).agg(
        F.countDistinct("event_type").alias("unique_event_types"),
        F.countDistinct("product_id").alias("unique_products"),
        F.countDistinct("category_id").alias("unique_categories"),
        F.count("*").alias("event_count"),
        F.max("user_id").alias("user_id"),
        F.max("session_value").alias("session_value"),
        sessions.duration().alias("duration_seconds"),
    )
