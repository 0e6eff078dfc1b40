"""Queries on encoders, profiles, schemas, filters and splits."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sessionloom.cluster import fresh_path
from sessionloom.functions.fixed_values import EVENT_CODES, UNKNOWN_WORD
from sessionloom.functions.ratios import finite_columns
from sessionloom.operators import columns as cols
from sessionloom.operators import encode, profile
from sessionloom.operators.lookup import code_of
from sessionloom.plans.common import rounded, test_part, train_part
from sessionloom.plans.registry import query
from sessionloom.plans.session_queries import ALL_TYPES, KEY
from sessionloom.sources.files import stage
from sessionloom.sources.fixtures import EVENTS_SQL, session_events, staged_events, table

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# --- encoders -----------------------------------------------------------------------------


@query(
    "label_codes",
    EVENTS_SQL
    + """
SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS event_type_code,
       dense_rank() OVER (ORDER BY product_id) - 1 AS product_id_code FROM ev""",
)
def label_codes(spark, folder):
    events = staged_events(spark, folder).select("event_id", "event_type", "product_id")
    return encode.codes(encode.codes(events, "event_type"), "product_id").select(
        "event_id", "event_type_code", "product_id_code"
    )


@query(
    "label_codes_unknown",
    EVENTS_SQL
    + """,
d AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code
      FROM (SELECT event_type AS v FROM ev WHERE event_type <> 'BUY' UNION SELECT 'Unknown'))
SELECT event_id, coalesce(code, (SELECT code FROM d WHERE v = 'Unknown')) AS event_type_code
FROM ev LEFT JOIN d ON event_type = v""",
)
def label_codes_unknown(spark, folder):
    events = staged_events(spark, folder).select("event_id", "event_type")
    seen = events.where(F.col("event_type") != "BUY")
    coded = encode.codes(events, "event_type", fit_on=seen, sentinel="Unknown")
    return coded.select("event_id", "event_type_code")


@query(
    "ordinal_unknown",
    EVENTS_SQL
    + """,
d AS (SELECT user_session, row_number() OVER (ORDER BY user_session) - 1 AS code
      FROM (SELECT DISTINCT user_session FROM ev WHERE split = 'train'))
SELECT event_id, coalesce(code, -1) AS user_session_code FROM ev LEFT JOIN d USING (user_session)""",
)
def ordinal_unknown(spark, folder):
    events = staged_events(spark, folder).select("event_id", "split", KEY)
    coded = encode.codes(events, KEY, fit_on=train_part(events), unseen=-1)
    return coded.select("event_id", "user_session_code")


@query(
    "one_hot_events",
    EVENTS_SQL
    + "SELECT event_id, "
    + ", ".join(f"""CAST(event_type = '{t}' AS INTEGER) AS "event_{t}" """ for t in ALL_TYPES)
    + " FROM ev",
)
def one_hot_events(spark, folder):
    events = staged_events(spark, folder).select("event_id", "event_type")
    values = encode.distinct_values(events, "event_type")
    return encode.one_hot(events, "event_type", values, "event")


@query(
    "event_type_code",
    EVENTS_SQL
    + """
SELECT event_id,
  CASE event_type WHEN 'ADD_CART' THEN 0 WHEN 'BUY' THEN 1 WHEN 'REMOVE_CART' THEN 2
       WHEN 'VIEW' THEN 3 END AS code_a,
  CASE event_type WHEN 'ADD_CART' THEN 0 WHEN 'VIEW' THEN 1 WHEN 'REMOVE_CART' THEN 2
       WHEN 'BUY' THEN 3 END AS code_b
FROM ev""",
)
def event_type_code(spark, folder):
    return session_events(spark, folder).select(
        "event_id",
        code_of("event_type", EVENT_CODES["alphabetical"]).alias("code_a"),
        code_of("event_type", EVENT_CODES["funnel"]).alias("code_b"),
    )


PRIORITY = {"1-URGENT": 4, "2-HIGH": 3, "3-MEDIUM": 2, "4-NOT SPECIFIED": 0}


@query(
    "ordinal_priority",
    """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3
  WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 0 ELSE -1 END AS priority_code,
  CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 END AS segment_code
FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def ordinal_priority(spark, folder):
    orders, customers = table(spark, folder, "orders"), table(spark, folder, "customer")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return joined.select(
        "o_orderkey",
        code_of("o_orderpriority", PRIORITY, -1).alias("priority_code"),
        code_of("c_mktsegment", {"BUILDING": 1, "MACHINERY": 2}).alias("segment_code"),
    )


@query(
    "one_hot_wide",
    """
SELECT l_partkey, CAST(dense_rank() OVER (ORDER BY l_partkey) - 1 AS BIGINT) AS place, CAST(count(*) AS DOUBLE) AS total
FROM lineitem GROUP BY l_partkey""",
)
def one_hot_wide(spark, folder):
    """Column totals of the vectors beside the value of each place."""
    lines = table(spark, folder, "lineitem").select("l_partkey")
    wide = encode.one_hot_vector(lines, "l_partkey", "vector", code="place")
    by_place = encode.vector_totals(wide, "vector")
    places = wide.select("l_partkey", "place").distinct()
    return places.join(by_place, places["place"] == by_place["at"]).select("l_partkey", "place", "total")


@query(
    "equal_width_segments",
    """
SELECT c_custkey, CASE WHEN mx = mn THEN 'medium' ELSE
  ['low', 'medium', 'high'][CAST(greatest(1, least(3, ceil((c_acctbal - mn) * 3 / (mx - mn))))
                                 AS INTEGER)] END AS segment
FROM (SELECT *, min(c_acctbal) OVER () AS mn, max(c_acctbal) OVER () AS mx FROM customer)""",
)
def equal_width_segments(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    cut = encode.equal_width(customers, "c_acctbal", ["low", "medium", "high"], "segment")
    return cut.select("c_custkey", "segment")


@query(
    "standard_scale",
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM lineitem WHERE l_orderkey % 5 <> 0))"
        f" / (SELECT stddev_pop({c}) FROM lineitem WHERE l_orderkey % 5 <> 0) + 3e-9, 6) AS {c}"
        for c in LINE_NUMBERS
    )
    + " FROM lineitem",
)
def standard_scale(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *LINE_NUMBERS)
    fitted = lines.where(F.col("l_orderkey") % 5 != 0)
    return rounded(encode.standardize(lines, LINE_NUMBERS, fitted))


@query(
    "feature_vector",
    "SELECT l_orderkey, l_linenumber, round(l_quantity + 3e-9, 6) AS f0,"
    " round(l_extendedprice + 3e-9, 6) AS f1, round(l_discount + 3e-9, 6) AS f2,"
    " round(l_tax + 3e-9, 6) AS f3 FROM lineitem",
)
def feature_vector(spark, folder):
    lines = encode.feature_vector(table(spark, folder, "lineitem"), LINE_NUMBERS)
    dense = vector_to_array("features")
    return rounded(
        lines.select(
            "l_orderkey", "l_linenumber", *[dense[i].alias(f"f{i}") for i in range(len(LINE_NUMBERS))]
        )
    )


# --- profiles -----------------------------------------------------------------------------


@query(
    "iqr_filter",
    EVENTS_SQL
    + """,
s AS (SELECT user_session, max(session_value) AS session_value FROM ev WHERE split = 'train'
      GROUP BY user_session),
q AS (SELECT quantile_cont(session_value, 0.25) AS q1, quantile_cont(session_value, 0.75) AS q3
      FROM s)
SELECT user_session, session_value FROM s, q
WHERE session_value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""",
)
def iqr_filter(spark, folder):
    train = train_part(session_events(spark, folder))
    labelled = train.groupBy(KEY).agg(F.max("session_value").alias("session_value"))
    labelled = stage(labelled, fresh_path(spark, "labelled"))
    return profile.iqr_filter(labelled, "session_value")


@query(
    "quantiles",
    "SELECT column_name, p, round(v + 3e-9, 6) AS v FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({p} AS DOUBLE) AS p, quantile_cont({c}, {p}) AS v"
        " FROM lineitem"
        for c in LINE_NUMBERS
        for p in (0.05, 0.25, 0.5, 0.75, 0.99)
    )
    + ")",
)
def quantiles(spark, folder):
    probs = [0.05, 0.25, 0.5, 0.75, 0.99]
    found = profile.exact_quantiles(table(spark, folder, "lineitem"), LINE_NUMBERS, probs)
    rows = [(c, p, v) for c in LINE_NUMBERS for p, v in zip(probs, found[c])]
    return rounded(spark.createDataFrame(rows, "column_name string, p double, v double"))


@query(
    "describe_value",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS count,
  round(avg({c}) + 3e-9, 4) AS mean, round(stddev_samp({c}) + 3e-9, 4) AS std,
  round(min({c}) + 3e-9, 4) AS min, round(quantile_cont({c}, 0.25) + 3e-9, 4) AS q25,
  round(quantile_cont({c}, 0.5) + 3e-9, 4) AS median,
  round(quantile_cont({c}, 0.75) + 3e-9, 4) AS q75, round(max({c}) + 3e-9, 4) AS max
FROM lineitem"""
        for c in LINE_NUMBERS
    ),
)
def describe_value(spark, folder):
    return rounded(profile.describe(table(spark, folder, "lineitem"), LINE_NUMBERS), 4)


@query(
    "value_histogram",
    """
WITH e AS (SELECT min(value) AS mn, max(value) AS mx FROM events),
b AS (SELECT CAST(least(floor((value - mn) * 50 / (mx - mn)), 49) AS INTEGER) AS bin
      FROM events, e),
n AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT CAST(r.bin AS INTEGER) AS bin, round(mn + r.bin * ((mx - mn) / 50) + 3e-9, 6) AS bin_start,
       coalesce(n, 0) AS n
FROM (SELECT unnest(range(50)) AS bin) r CROSS JOIN e LEFT JOIN n ON n.bin = r.bin""",
)
def value_histogram(spark, folder):
    return rounded(profile.histogram(table(spark, folder, "events"), "value", 50))


@query(
    "null_profile",
    EVENTS_SQL
    + """
SELECT * FROM (
SELECT 'session_value' AS column_name, count(*) - count(session_value) AS n_null FROM ev
UNION ALL SELECT 'bought', count(*) FILTER (event_type <> 'BUY') FROM ev)""",
)
def null_profile(spark, folder):
    events = session_events(spark, folder)
    bought = F.when(F.col("event_type") == "BUY", F.col("product_id"))
    return profile.null_profile(events.withColumn("bought", bought))


DOMAIN_COLUMNS = ["event_type", "category_id", "product_id", "split"]


@query(
    "domain_profile",
    EVENTS_SQL
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct,
  CASE WHEN count(DISTINCT {c}) <= 20 THEN string_agg(DISTINCT {c}, ',' ORDER BY {c}) END
    AS listed_values FROM ev"""
        for c in DOMAIN_COLUMNS
    ),
)
def domain_profile(spark, folder):
    return profile.domain_profile(session_events(spark, folder), DOMAIN_COLUMNS)


@query(
    "table_profile",
    """
SELECT 'rows' AS fact, count(*) AS n FROM lineitem
UNION ALL SELECT 'columns', 11 UNION ALL SELECT 'type bigint', 3
UNION ALL SELECT 'type double', 4 UNION ALL SELECT 'type int', 1
UNION ALL SELECT 'type string', 2 UNION ALL SELECT 'type timestamp_ntz', 1""",
)
def table_profile(spark, folder):
    return profile.table_profile(table(spark, folder, "lineitem"))


@query(
    "row_counts",
    EVENTS_SQL
    + """
SELECT count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test,
       count(*) FILTER (event_type = 'OTHER') AS n_other FROM ev""",
)
def row_counts(spark, folder):
    return session_events(spark, folder).agg(
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"),
        F.count_if(F.col("event_type") == "OTHER").alias("n_other"),
    )


@query("drop_null_columns", EVENTS_SQL + "SELECT * EXCLUDE (session_value) FROM ev")
def drop_null_columns(spark, folder):
    return cols.drop_null_columns(staged_events(spark, folder))


@query(
    "inf_to_null",
    EVENTS_SQL
    + """
SELECT user_session, round(views / nullif(buys, 0) + 3e-9, 6) AS views_per_buy,
       round(coalesce(views / nullif(buys, 0), 0) + 3e-9, 6) AS views_per_buy_zero,
       nullif(kind, '') AS kind
FROM (SELECT user_session, count(*) FILTER (event_type = 'VIEW') AS views,
             count(*) FILTER (event_type = 'BUY') AS buys,
             CASE WHEN count(*) FILTER (event_type = 'BUY') > 0 THEN 'buyer' ELSE '' END AS kind
      FROM ev GROUP BY user_session)""",
)
def inf_to_null(spark, folder):
    counts = staged_events(spark, folder).groupBy(KEY).agg(
        F.count_if(F.col("event_type") == "VIEW").cast("double").alias("views"),
        F.count_if(F.col("event_type") == "BUY").cast("double").alias("buys"),
    )
    # Division as arrays do it: x / 0 is infinite, 0 / 0 is not a number.
    endless = F.when(F.col("views") > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    ratio = F.when(F.col("buys") == 0, endless).otherwise(F.try_divide("views", "buys"))
    rows = counts.select(
        KEY,
        ratio.alias("views_per_buy"),
        F.when(F.col("buys") > 0, "buyer").otherwise("").alias("kind"),
    )
    zero = finite_columns(rows, 0.0).select(KEY, F.col("views_per_buy").alias("views_per_buy_zero"))
    return rounded(cols.blank_to_null(finite_columns(rows)).join(zero, KEY))


CORR_COLUMNS = LINE_NUMBERS


@query(
    "corr_long",
    "SELECT a, b, round(r + 3e-9, 6) AS r FROM ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem"
        for a in CORR_COLUMNS
        for b in CORR_COLUMNS
    )
    + ")",
)
def corr_long(spark, folder):
    return rounded(profile.corr_long(table(spark, folder, "lineitem"), CORR_COLUMNS))


@query(
    "corr_with_target",
    "SELECT column_name, round(r + 3e-9, 6) AS r FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, corr({c}, l_extendedprice) AS r FROM lineitem"
        for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")
    )
    + ")",
)
def corr_with_target(spark, folder):
    names = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    return rounded(profile.corr_with(table(spark, folder, "lineitem"), names, "l_extendedprice"))


@query(
    "corr_selected_columns",
    "SELECT l_extendedprice, round(l_extendedprice * (1 - l_discount) + 3e-9, 6) AS net"
    " FROM lineitem",
)
def corr_selected_columns(spark, folder):
    lines = table(spark, folder, "lineitem").select(*LINE_NUMBERS)
    lines = lines.withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return rounded(profile.keep_correlated(lines, "l_extendedprice", 0.4))


# --- schemas and rows ---------------------------------------------------------------------


@query(
    "clean_names",
    "SELECT o_orderkey AS oorderkey, o_custkey AS ocustkey, o_orderstatus AS oorderstatus,"
    " o_totalprice AS ototalprice, o_orderdate AS oorderdate, o_orderpriority AS oorderpriority"
    " FROM orders",
)
def clean_names(spark, folder):
    return cols.clean_names(table(spark, folder, "orders"))


@query(
    "project_rename",
    "SELECT o_orderkey AS user_session, o_totalprice AS session_value FROM orders",
)
def project_rename(spark, folder):
    renamed = {"o_orderkey": "user_session", "o_totalprice": "session_value"}
    orders = table(spark, folder, "orders").withColumnsRenamed(renamed)
    return orders.drop("o_orderdate", "not_there").select("user_session", "session_value")


@query("positional_drop", "SELECT * EXCLUDE (o_orderkey) FROM orders")
def positional_drop(spark, folder):
    return cols.drop_first(table(spark, folder, "orders"))


@query("typed_columns", "SELECT o_totalprice, o_orderkey, o_custkey FROM orders")
def typed_columns(spark, folder):
    orders = table(spark, folder, "orders")
    numbers = set(cols.columns_of_type(orders, "bigint", "double"))
    named = [c for c in cols.columns_like(orders, "^o_(total|order|cust)") if c in numbers]
    return orders.select(*named)


@query("sorted_columns", "SELECT * FROM orders")
def sorted_columns(spark, folder):
    return cols.sort_columns(table(spark, folder, "orders"))


@query(
    "bulk_cast",
    """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey,
       TRY_CAST(o_orderstatus AS INTEGER) AS o_orderstatus, o_totalprice, o_orderdate,
       TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS o_orderpriority
FROM orders""",
)
def bulk_cast(spark, folder):
    orders = table(spark, folder, "orders")
    orders = orders.withColumn("o_orderpriority", F.substring("o_orderpriority", 1, 1))
    spec = {
        "o_orderkey": "string", "o_custkey": "int", "o_orderstatus": "int",
        "o_orderpriority": "int", "not_there": "int",
    }
    return cols.cast_all(orders, spec)


@query("template_label", "SELECT max(o_totalprice) AS label_max FROM orders")
def template_label(spark, folder):
    template = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return template.agg(F.max(cols.label_column(template)).alias("label_max"))


@query("equality_filter", EVENTS_SQL + "SELECT event_id, value FROM ev WHERE event_type = 'BUY'")
def equality_filter(spark, folder):
    events = session_events(spark, folder)
    return events.where(F.col("event_type") == "BUY").select("event_id", "value")


@query(
    "isin_filter",
    EVENTS_SQL + "SELECT event_id FROM ev WHERE event_type IN ('BUY', 'ADD_CART')",
)
def isin_filter(spark, folder):
    events = session_events(spark, folder)
    return events.where(F.col("event_type").isin("BUY", "ADD_CART")).select("event_id")


@query(
    "drop_null_label",
    EVENTS_SQL + "SELECT event_id, session_value FROM ev WHERE session_value IS NOT NULL",
)
def drop_null_label(spark, folder):
    events = session_events(spark, folder).select("event_id", "session_value")
    return events.dropna(subset=["session_value"])


@query(
    "labelled_split",
    EVENTS_SQL
    + """
SELECT 'labelled' AS part, count(*) AS n FROM ev WHERE session_value IS NOT NULL
UNION ALL SELECT 'unlabelled', count(*) FROM ev WHERE session_value IS NULL""",
)
def labelled_split(spark, folder):
    events = staged_events(spark, folder)
    parts = {
        "labelled": events.where(F.col("session_value").isNotNull()),
        "unlabelled": events.where(F.col("session_value").isNull()),
    }
    return cols.stack_parts(parts, "part").groupBy("part").agg(F.count("*").alias("n"))


@query(
    "not_null_flag",
    EVENTS_SQL
    + "SELECT event_id, CAST(session_value IS NOT NULL AS INTEGER) AS has_label FROM ev",
)
def not_null_flag(spark, folder):
    events = session_events(spark, folder)
    return events.select("event_id", cols.not_null_flag("session_value").alias("has_label"))


@query(
    "masked_update",
    EVENTS_SQL + "SELECT event_id, CASE WHEN value < 10 THEN 0 ELSE value END AS value FROM ev",
)
def masked_update(spark, folder):
    events = session_events(spark, folder)
    return events.select("event_id", cols.masked(F.col("value") < 10, 0.0, "value").alias("value"))


FEATURES = ["views", "buys", "total_events", "only_in_train"]


def _train_and_test(events):
    counts = [
        F.count_if(F.col("event_type") == "VIEW").alias("views"),
        F.count_if(F.col("event_type") == "BUY").alias("buys"),
        F.count("*").alias("total_events"),
    ]
    train = train_part(events).groupBy(KEY).agg(*counts, F.max("value").alias("only_in_train"))
    test = test_part(events).groupBy(KEY).agg(*counts, F.max("value").alias("only_in_test"))
    return train, test


@query(
    "align_columns",
    EVENTS_SQL
    + """
SELECT user_session, count(*) FILTER (event_type = 'VIEW') AS views,
       count(*) FILTER (event_type = 'BUY') AS buys, count(*) AS total_events, 0 AS only_in_train
FROM ev WHERE split = 'test' GROUP BY user_session""",
)
def align_columns(spark, folder):
    _, test = _train_and_test(session_events(spark, folder))
    return cols.align_to(test, [KEY, *FEATURES])


@query(
    "common_columns",
    EVENTS_SQL
    + """
SELECT user_session, count(*) FILTER (event_type = 'VIEW') AS views,
       count(*) FILTER (event_type = 'BUY') AS buys, count(*) AS total_events
FROM ev WHERE split = 'test' GROUP BY user_session""",
)
def common_columns(spark, folder):
    train, test = _train_and_test(session_events(spark, folder))
    return test.select(*cols.common_columns(train, test))


@query(
    "schema_diff",
    EVENTS_SQL
    + """
SELECT 'only_in_train' AS column_name, 'left' AS only_in,
       (SELECT count(DISTINCT user_session) FROM ev WHERE split = 'train') AS n_values
UNION ALL
SELECT 'only_in_test', 'right',
       (SELECT count(DISTINCT user_session) FROM ev WHERE split = 'test')""",
)
def schema_diff(spark, folder):
    train, test = _train_and_test(staged_events(spark, folder))
    diff = cols.schema_diff(train, test)
    filled = [
        df.unpivot([], [F.col(c).cast("string").alias(c) for c in only], "column_name", "_v")
        for df, only in (
            (train, [c for c in train.columns if c not in test.columns]),
            (test, [c for c in test.columns if c not in train.columns]),
        )
    ]
    counts = filled[0].unionByName(filled[1]).groupBy("column_name").agg(
        F.count("_v").alias("n_values")
    )
    return diff.join(counts, "column_name", "left")


@query(
    "union_by_name",
    EVENTS_SQL
    + "SELECT event_id, product_id, session_value, split FROM ev",
)
def union_by_name(spark, folder):
    events = staged_events(spark, folder).select("event_id", "product_id", "session_value", "split")
    parts = {
        "train": train_part(events).drop("split"),
        "test": test_part(events).drop("split", "session_value"),
    }
    return cols.stack_parts(parts)


@query(
    "head_tail",
    EVENTS_SQL
    + """
SELECT * FROM (SELECT event_id, value, 'head' AS part FROM ev ORDER BY event_id LIMIT 10)
UNION ALL
SELECT * FROM (SELECT event_id, value, 'tail' AS part FROM ev ORDER BY event_id DESC LIMIT 10)""",
)
def head_tail(spark, folder):
    from sessionloom.sources.files import head_tail as preview

    return preview(table(spark, folder, "events").select("event_id", "value"), "event_id", 10)


@query(
    "value_counts_sorted",
    EVENTS_SQL + "SELECT product_id, count(*) AS n FROM ev GROUP BY product_id",
)
def value_counts_sorted(spark, folder):
    counts = session_events(spark, folder).groupBy("product_id").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "product_id")


@query(
    "fill_missing",
    EVENTS_SQL
    + """
SELECT event_id, round(coalesce(session_value,
         (SELECT avg(session_value) FROM ev WHERE split = 'train')) + 3e-9, 6) AS filled_value,
       coalesce(CASE WHEN event_type = 'BUY' THEN product_id END, 'bilinmiyor') AS bought
FROM ev""",
)
def fill_missing(spark, folder):
    events = staged_events(spark, folder)
    mean = train_part(events).agg(F.avg("session_value")).scalar()
    bought = F.when(F.col("event_type") == "BUY", F.col("product_id"))
    rows = events.select(
        "event_id", F.coalesce("session_value", mean).alias("filled_value"), bought.alias("bought")
    )
    return rounded(rows.na.fill({"bought": UNKNOWN_WORD}))
