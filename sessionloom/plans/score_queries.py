"""Queries on predictions, files and models."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.cluster import cut_lineage, fresh_path
from sessionloom.functions.fixed_values import BAGGING_SEEDS
from sessionloom.operators import history, leastsq, models, profile, score
from sessionloom.operators.encode import feature_vector
from sessionloom.operators.extra_trees import fit_extra_trees
from sessionloom.operators.lookup import attach
from sessionloom.operators.sessions import basic_features, main_value, mean_per_key
from sessionloom.plans.common import (
    TIE_SHIFT, key_hash_sql, least_squares_sql, rounded, sql_rounded, test_part, train_part,
)
from sessionloom.plans.registry import query
from sessionloom.plans.session_queries import KEY, RICH_COUNTS, RICH_SQL, rich
from sessionloom.sources import files
from sessionloom.sources.fixtures import EVENTS_SQL, session_events, staged_events, table

# --- predictions: three simple formulas stand in for fitted models -----------------------------

FORMULAS = {
    "counts": "12.5 * event_count + 3 * unique_products",
    "products": "60 * unique_products - 250",
    "types": "140 * unique_event_types - 30",
}
LONG_SQL = (
    """,
base AS (SELECT user_session, split, max(session_value) AS session_value,
           count(DISTINCT event_type) AS unique_event_types,
           count(DISTINCT product_id) AS unique_products, count(*) AS event_count
         FROM ev GROUP BY user_session, split),
long AS ("""
    + " UNION ALL ".join(
        f"SELECT user_session, split, session_value, '{name}' AS model,"
        f" CAST({formula} AS DOUBLE) AS prediction FROM base"
        for name, formula in FORMULAS.items()
    )
    + """),
scores AS (
  SELECT model, avg((session_value - prediction) ** 2) AS mse,
         sqrt(avg((session_value - prediction) ** 2)) AS rmse,
         avg(abs(session_value - prediction)) AS mae,
         1 - avg((session_value - prediction) ** 2) / var_pop(session_value) AS r2
  FROM long WHERE split = 'train' GROUP BY model)"""
)


def _long(events):
    base = basic_features(events)
    options = F.array(
        *[
            F.struct(F.lit(name).alias("model"), F.expr(formula).cast("double").alias("prediction"))
            for name, formula in FORMULAS.items()
        ]
    )
    return base.select(KEY, "session_value", F.explode(options).alias("o")).select(
        KEY, "session_value", "o.model", "o.prediction"
    )


def _scores(events):
    return score.metrics(_long(train_part(events)), "session_value", "prediction", ["model"])


SCORE_COLUMNS_SQL = ", ".join(f"round({c} + 3e-9, 6) AS {c}" for c in ("mse", "rmse", "mae", "r2"))

ROW_PREDICTION_SQL = "(value * 1.5 - 20)"


def _row_predictions(events):
    return events.select(
        KEY, "event_id", "event_time", "split", "value",
        (F.col("value") * 1.5 - 20).alias("prediction"),
    )


@query(
    "prediction_mean_per_session",
    EVENTS_SQL
    + f"""
SELECT user_session, round(avg({ROW_PREDICTION_SQL}) + 3e-9, 6) AS session_value
FROM ev WHERE split = 'test' GROUP BY user_session""",
)
def prediction_mean_per_session(spark, folder):
    predictions = _row_predictions(test_part(session_events(spark, folder)))
    return rounded(mean_per_key(predictions, "prediction", to="session_value"))


@query(
    "prediction_last_wins",
    EVENTS_SQL
    + f"""
SELECT user_session,
       round(arg_max({ROW_PREDICTION_SQL}, (event_time, event_id)) + 3e-9, 6) AS prediction
FROM ev WHERE split = 'test' GROUP BY user_session""",
)
def prediction_last_wins(spark, folder):
    from sessionloom.operators.lookup import last_wins

    predictions = _row_predictions(test_part(session_events(spark, folder)))
    return rounded(last_wins(predictions, KEY, "prediction", ["event_time", "event_id"]))


@query(
    "prediction_repair",
    EVENTS_SQL
    + f"""
, p AS (SELECT * FROM ev WHERE split = 'test' AND user_id % 2 = 0),
l AS (SELECT user_session, arg_max({ROW_PREDICTION_SQL}, event_id) AS prediction
      FROM p GROUP BY user_session),
t AS (SELECT DISTINCT user_session FROM ev WHERE split = 'test')
SELECT user_session,
       round(coalesce(prediction, (SELECT avg({ROW_PREDICTION_SQL}) FROM p)) + 3e-9, 6)
         AS prediction
FROM t LEFT JOIN l USING (user_session)""",
)
def prediction_repair(spark, folder):
    test = test_part(staged_events(spark, folder))
    predictions = _row_predictions(test.where("user_id % 2 = 0"))
    template = test.select(KEY).distinct()
    return rounded(score.repair_predictions(template, predictions, KEY, "prediction", "event_id"))


@query(
    "unmatched_sessions",
    EVENTS_SQL
    + """
SELECT count(DISTINCT user_session) AS n_unmatched FROM ev
WHERE split = 'test' AND user_id % 2 <> 0""",
)
def unmatched_sessions(spark, folder):
    test = test_part(staged_events(spark, folder))
    template = test.select(KEY).distinct()
    return score.unmatched(template, test.where("user_id % 2 = 0"), KEY)


@query(
    "clip_predictions",
    EVENTS_SQL
    + f"""
SELECT event_id, round(greatest({ROW_PREDICTION_SQL}, 0) + 3e-9, 6) AS prediction FROM ev""",
)
def clip_predictions(spark, folder):
    predictions = _row_predictions(session_events(spark, folder))
    clipped = score.clip_predictions(predictions, "prediction")
    return rounded(clipped.select("event_id", "prediction"))


@query(
    "negative_share",
    EVENTS_SQL
    + f"""
SELECT split, count(*) AS n, round(avg(p) + 3e-9, 6) AS mean, round(stddev_pop(p) + 3e-9, 6) AS std,
       round(min(p) + 3e-9, 6) AS min, round(max(p) + 3e-9, 6) AS max,
       count(*) FILTER (p < 0) AS n_negative,
       round(count(*) FILTER (p < 0) / count(*) + 3e-9, 6) AS negative_share
FROM (SELECT split, {ROW_PREDICTION_SQL} AS p FROM ev) GROUP BY split""",
)
def negative_share(spark, folder):
    predictions = _row_predictions(session_events(spark, folder))
    return rounded(score.prediction_summary(predictions, "prediction", ["split"]))


@query(
    "wide_prediction_mean",
    EVENTS_SQL
    + LONG_SQL
    + """
SELECT user_session, round((a + b) / 2 + 3e-9, 6) AS mean_2, round((a + b + c) / 3 + 3e-9, 6) AS mean_3
FROM (SELECT user_session, max(prediction) FILTER (model = 'counts') AS a,
             max(prediction) FILTER (model = 'products') AS b,
             max(prediction) FILTER (model = 'types') AS c FROM long GROUP BY user_session)""",
)
def wide_prediction_mean(spark, folder):
    names = list(FORMULAS)
    long = _long(session_events(spark, folder))
    wide = score.side_by_side(long, KEY, "model", "prediction", names)
    return rounded(
        wide.select(
            KEY,
            score.row_mean(wide, names[:2]).alias("mean_2"),
            score.row_mean(wide, names).alias("mean_3"),
        )
    )


@query(
    "side_by_side",
    EVENTS_SQL
    + LONG_SQL
    + """
SELECT user_session, max(prediction) FILTER (model = 'counts') AS counts,
       max(prediction) FILTER (model = 'products') AS products,
       max(prediction) FILTER (model = 'types') AS types FROM long GROUP BY user_session""",
)
def side_by_side(spark, folder):
    long = _long(session_events(spark, folder))
    return score.side_by_side(long, KEY, "model", "prediction", list(FORMULAS))


@query(
    "ensemble_mean",
    EVENTS_SQL
    + LONG_SQL
    + """
SELECT user_session, round(avg(prediction) + 3e-9, 6) AS prediction
FROM long WHERE split = 'test' GROUP BY user_session""",
)
def ensemble_mean(spark, folder):
    long = _long(test_part(session_events(spark, folder)))
    return rounded(score.ensemble_mean(long, KEY, "prediction"))


@query(
    "ensemble_weighted",
    EVENTS_SQL
    + LONG_SQL
    + """
SELECT user_session, round(sum(prediction / rmse) / sum(1 / rmse) + 3e-9, 6) AS prediction
FROM long JOIN scores USING (model) WHERE split = 'test' GROUP BY user_session""",
)
def ensemble_weighted(spark, folder):
    events = staged_events(spark, folder)
    weights = score.inverse_error_weights(_scores(events))
    return rounded(score.blend(_long(test_part(events)), weights, KEY, "prediction"))


@query("model_metrics", EVENTS_SQL + LONG_SQL + f"SELECT model, {SCORE_COLUMNS_SQL} FROM scores")
def model_metrics(spark, folder):
    return rounded(_scores(session_events(spark, folder)))


@query(
    "model_leaderboard",
    EVENTS_SQL + LONG_SQL + f"SELECT model, {SCORE_COLUMNS_SQL} FROM scores ORDER BY scores.rmse",
)
def model_leaderboard(spark, folder):
    return rounded(score.leaderboard(_scores(session_events(spark, folder))))


@query(
    "best_model",
    EVENTS_SQL
    + LONG_SQL
    + "SELECT model, round(s.rmse + 3e-9, 6) AS rmse FROM scores s ORDER BY s.rmse LIMIT 1",
)
def best_model(spark, folder):
    return rounded(score.best_model(_scores(session_events(spark, folder))))


@query(
    "top_models",
    EVENTS_SQL
    + LONG_SQL
    + "SELECT model, round(s.rmse + 3e-9, 6) AS rmse FROM scores s ORDER BY s.rmse LIMIT 2",
)
def top_models(spark, folder):
    scores = _scores(session_events(spark, folder))
    return rounded(score.leaderboard(scores, 2).select("model", "rmse"))


GROUPS = {
    "event_counts": ["event_count", "unique_event_types"],
    "product_features": ["unique_products", "unique_categories"],
}


@query(
    "importance_by_group",
    EVENTS_SQL
    + """,
b AS (SELECT user_session, max(session_value) AS y, count(DISTINCT event_type) AS t,
             count(DISTINCT product_id) AS p, count(DISTINCT category_id) AS c, count(*) AS n
      FROM ev WHERE split = 'train' GROUP BY user_session)
SELECT 'event_counts' AS feature_group,
       round(abs(corr(n, y)) + abs(corr(t, y)) + 3e-9, 6) AS importance FROM b
UNION ALL
SELECT 'product_features', round(abs(corr(p, y)) + abs(corr(c, y)) + 3e-9, 6) FROM b""",
)
def importance_by_group(spark, folder):
    sessions = basic_features(train_part(session_events(spark, folder)))
    names = [name for group in GROUPS.values() for name in group]
    strength = profile.corr_with(sessions, names, "session_value").select(
        F.col("column_name").alias("feature"), F.abs("r").alias("importance")
    )
    return rounded(score.importance_by_group(strength, GROUPS))


@query(
    "residual_histogram",
    EVENTS_SQL
    + LONG_SQL
    + """,
r AS (SELECT session_value - prediction AS v FROM long
      WHERE split = 'train' AND model = 'counts'),
e AS (SELECT min(v) AS mn, max(v) AS mx FROM r),
n AS (SELECT CAST(least(floor((v - mn) * 20 / (mx - mn)), 19) AS INTEGER) AS bin, count(*) AS n
      FROM r, e GROUP BY 1)
SELECT CAST(b.bin AS INTEGER) AS bin, round(mn + b.bin * ((mx - mn) / 20) + 3e-9, 6) AS bin_start,
       coalesce(n, 0) AS n
FROM (SELECT unnest(range(20)) AS bin) b CROSS JOIN e LEFT JOIN n ON n.bin = b.bin""",
)
def residual_histogram(spark, folder):
    long = _long(train_part(session_events(spark, folder))).where(F.col("model") == "counts")
    residuals = long.select((F.col("session_value") - F.col("prediction")).alias("residual"))
    return rounded(profile.histogram(residuals, "residual", 20))


@query(
    "random_assignment",
    EVENTS_SQL
    + f"""
, p AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS draw,
               {ROW_PREDICTION_SQL} AS prediction FROM ev WHERE split = 'test'),
t AS (SELECT DISTINCT user_session FROM ev WHERE split = 'test')
SELECT user_session, round(prediction + 3e-9, 6) AS prediction
FROM t JOIN p ON draw = {key_hash_sql("user_session", 42)} % (SELECT count(*) FROM p)""",
)
def random_assignment(spark, folder):
    test = test_part(staged_events(spark, folder))
    template = test.select(KEY).distinct()
    assigned = score.assign_at_random(
        template, _row_predictions(test), KEY, "event_id", "prediction", 42
    )
    return rounded(assigned)


@query(
    "sample_rows",
    EVENTS_SQL
    + f"""
SELECT event_id, user_session, value FROM ev
ORDER BY {key_hash_sql("event_id", 42)}, event_id LIMIT 20""",
)
def sample_rows(spark, folder):
    events = session_events(spark, folder).select("event_id", KEY, "value")
    return score.sample_rows(events, "event_id", 20, 42)


@query(
    "hash_split",
    EVENTS_SQL
    + f"""
SELECT event_id, user_session, {key_hash_sql("user_session", 42)} % 100 < 20 AS is_validation
FROM ev""",
)
def hash_split(spark, folder):
    return models.hash_split(session_events(spark, folder).select("event_id", KEY), KEY)


# --- files --------------------------------------------------------------------------------


def _event_csv(spark, folder):
    events = session_events(spark, folder).select(
        "event_time", "event_type", "product_id", "category_id",
        F.concat(F.lit("USER_"), F.col("user_id").cast("string")).alias("user_id"),
        KEY, "session_value",
    )
    return files.write_csv(events, fresh_path(spark, "events-csv"))


EVENT_FILE_SQL = """
SELECT event_time, event_type, product_id, category_id, 'USER_' || user_id AS user_id, user_session,
       session_value FROM ev"""


@query("csv_roundtrip", EVENTS_SQL + EVENT_FILE_SQL)
def csv_roundtrip(spark, folder):
    return files.read_events(spark, _event_csv(spark, folder))


EVENT_COLUMNS = ["event_time", "event_type", "product_id", "category_id", "user_id", KEY, "session_value"]


def _mixed_csv(spark, folder):
    """The log in four folders by event number: as it is; other order and times with a space; times in
    UTC and no label; labels NaN, some times no times, and lines that are cut short."""
    base = fresh_path(spark, "mixed-csv")
    events = staged_events(spark, folder).withColumn(
        "user_id", F.concat(F.lit("USER_"), F.col("user_id").cast("string"))
    )
    time = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    spaced, zoned = F.translate(time, "T", " "), F.concat(time, F.lit("Z"))
    broken = F.when(F.col("event_id") % 40 == 3, "soon").otherwise(time)
    late = [c for c in EVENT_COLUMNS if c != "event_time"]
    forms = [
        (time, EVENT_COLUMNS, F.col("session_value").cast("string")),
        (spaced, [KEY, "session_value", *EVENT_COLUMNS[1:5], "event_time"], F.col("session_value").cast("string")),
        (zoned, [c for c in EVENT_COLUMNS if c != "session_value"], None),
        (broken, [*late[:3], "event_time", *late[3:]], F.lit("NaN")),
    ]
    for i, (when, names, label) in enumerate(forms):
        part = events.where(F.col("event_id") % 4 == i).withColumn("event_time", when)
        part = part if label is None else part.withColumn("session_value", label)
        files.write_csv(part.select(*names), f"{base}/log{i}")
    short = events.where(F.col("event_id") % 100 == 0).select(F.concat(F.lit("x,"), "product_id").alias("value"))
    header = spark.range(1).select(F.lit(",".join(EVENT_COLUMNS)).alias("value"))
    header.unionByName(short).coalesce(1).write.text(f"{base}/log4")  # the lines of one small file, in order
    return f"{base}/log*"


MIXED_SQL = """
SELECT CASE WHEN event_id % 40 <> 3 THEN event_time END AS event_time, event_type, product_id, category_id,
  'USER_' || user_id AS user_id, user_session, CASE WHEN event_id % 4 < 2 THEN session_value END AS session_value
FROM ev"""


@query("event_log_mixed_csv", EVENTS_SQL + MIXED_SQL)
def event_log_mixed_csv(spark, folder):
    return files.read_events(spark, _mixed_csv(spark, folder))


@query(
    "event_log_report",
    EVENTS_SQL
    + """
, f AS (SELECT 'log' || (event_id % 4) AS log, count(*) AS n_rows, 0 AS n_rejected,
    count(*) FILTER (event_id % 40 = 3) AS unread_event_time,
    count(*) FILTER (event_id % 4 = 3) AS unread_session_value FROM ev GROUP BY ALL
  UNION ALL SELECT 'log4', count(*), count(*), 0, 0 FROM ev WHERE event_id % 100 = 0)
SELECT log, n_rows, CAST(n_rejected AS BIGINT) AS n_rejected, unread_event_time, unread_session_value
FROM f WHERE n_rows > 0""",
)
def event_log_report(spark, folder):
    report = files.event_file_report(spark, _mixed_csv(spark, folder))
    counts = [c for c in report.columns if c != "file_path"]
    log = F.regexp_extract("file_path", r"/(log\d)/", 1).alias("log")
    return report.groupBy(log).agg(*[F.sum(c).alias(c) for c in counts])


@query(
    "multi_file_scan",
    EVENTS_SQL
    + """
SELECT user_session, round(avg(value) + 3e-9, 6) AS session_value, count(*) AS n_files
FROM (SELECT user_session, seed, avg(value) + seed AS value
      FROM ev CROSS JOIN (SELECT unnest([1, 2, 3]) AS seed) GROUP BY user_session, seed)
GROUP BY user_session""",
)
def multi_file_scan(spark, folder):
    base = fresh_path(spark, "seeds")
    means = session_events(spark, folder).groupBy(KEY).agg(F.avg("value").alias("session_value"))
    for seed in (1, 2, 3):
        shifted = means.withColumn("session_value", F.col("session_value") + seed)
        files.write_predictions(shifted, f"{base}/submission_show{seed}")
    schema = T.StructType(
        [T.StructField(KEY, T.StringType()), T.StructField("session_value", T.DoubleType())]
    )
    found = files.read_many(spark, f"{base}/submission_show*", schema)
    origin = F.regexp_extract("file_path", r"submission_show(\d+)", 1)
    return rounded(
        found.groupBy(KEY).agg(
            F.avg("session_value").alias("session_value"), F.countDistinct(origin).alias("n_files")
        )
    )


@query(
    "variant_sinks",
    EVENTS_SQL
    + LONG_SQL
    + """
SELECT model AS variant, user_session, round(greatest(prediction, 0) + 3e-9, 6) AS session_value
FROM long WHERE split = 'test'""",
)
def variant_sinks(spark, folder):
    long = _long(test_part(session_events(spark, folder)))
    clipped = score.clip_predictions(long, "prediction").select(
        F.col("model").alias("variant"), KEY, F.col("prediction").alias("session_value")
    )
    path = files.write_predictions(clipped, fresh_path(spark, "variants"), variant="variant")
    schema = T.StructType(
        [
            T.StructField(KEY, T.StringType()),
            T.StructField("session_value", T.DoubleType()),
            T.StructField("variant", T.StringType()),
        ]
    )
    return rounded(files.read_csv(spark, path, schema).select("variant", KEY, "session_value"))


@query(
    "checkpoint_roundtrip",
    EVENTS_SQL + "SELECT event_id, user_session, event_time, session_value FROM ev",
)
def checkpoint_roundtrip(spark, folder):
    events = session_events(spark, folder).select("event_id", KEY, "event_time", "session_value")
    return files.stage(events, fresh_path(spark, "stage"))


@query(
    "sink_check",
    EVENTS_SQL
    + """
SELECT count(*) AS n_rows, count(*) FILTER (event_time IS NULL) AS null_event_time,
  count(*) FILTER (event_type IS NULL) AS null_event_type,
  count(*) FILTER (product_id IS NULL) AS null_product_id,
  count(*) FILTER (category_id IS NULL) AS null_category_id,
  count(*) FILTER (user_id IS NULL) AS null_user_id,
  count(*) FILTER (user_session IS NULL) AS null_user_session,
  count(*) FILTER (session_value IS NULL) AS null_session_value
FROM ev""",
)
def sink_check(spark, folder):
    return files.check_written(files.read_events(spark, _event_csv(spark, folder)))


@query(
    "subset_export",
    EVENTS_SQL + "SELECT user_session, session_value FROM ev",
)
def subset_export(spark, folder):
    written = files.read_events(spark, _event_csv(spark, folder))
    subset = written.select(KEY, "session_value")
    path = files.write_predictions(subset, fresh_path(spark, "subset"))
    return files.read_csv(spark, path, subset.schema)


@query(
    "lookup_sheet",
    "SELECT DISTINCT split_part(p_name, ' ', 2) AS city, split_part(p_name, ' ', 1) AS district"
    " FROM part",
)
def lookup_sheet(spark, folder):
    words = F.split("p_name", " ")
    sheet = table(spark, folder, "part").select(
        words[1].alias("city"), words[0].alias("district")
    ).distinct()
    heading = spark.range(1).select(
        F.lit(0).alias("o"), F.lit("il").alias("city"), F.lit("ilce").alias("district")
    )
    rows = heading.unionByName(sheet.withColumn("o", F.lit(1)))
    path = files.write_csv(rows.sort("o", "city", "district").drop("o"), fresh_path(spark, "sheet"))
    return files.read_lookup(spark, path).drop("ord")


@query(
    "json_map",
    """
SELECT split_part(p_name, ' ', 1) AS key, max(p_brand) AS value FROM part GROUP BY 1""",
)
def json_map(spark, folder):
    parts = table(spark, folder, "part")
    entries = parts.groupBy(F.split("p_name", " ")[0].alias("k")).agg(F.max("p_brand").alias("v"))
    path = fresh_path(spark, "dictionary")
    entries.select(F.to_json(F.create_map("k", "v")).alias("value")).write.text(path)
    return files.read_json_map(spark, path, one_per_line=True)


@query("file_listing")
def file_listing(spark, folder):
    return files.list_files(spark, folder)


# --- models -------------------------------------------------------------------------------

BASIC = ["unique_event_types", "unique_products", "unique_categories", "event_count"]
FEATURES = [*RICH_COUNTS, "session_duration_seconds", "avg_inferred_price",
            "user_avg_session_value", "avg_category_popularity"]
GRID = {"maxDepth": [3, 5, 7], "numTrees": [5, 10, 20], "minInstancesPerNode": [1, 2, 4]}
BOOST_GRID = {"maxDepth": [2, 3, 4], "stepSize": [0.05, 0.1, 0.3], "maxIter": [5, 10]}


def _basic(spark, folder):
    events = session_events(spark, folder)
    sessions = basic_features(events)
    train = models.training_table(sessions, KEY, BASIC, "session_value")
    scoring = models.score_table(sessions.where(F.col("session_value").isNull()), KEY, BASIC)
    return train, scoring


def _rich_rows(spark, folder):
    """(labelled sessions without outliers, sessions to predict), from one written table."""
    sessions = rich(staged_events(spark, folder))
    sessions = files.stage(sessions, fresh_path(spark, "sessions"))
    labelled = profile.iqr_filter(
        sessions.where(F.col("session_value").isNotNull()), "session_value"
    )
    return labelled, sessions.where(F.col("session_value").isNull())


def _rich(spark, folder):
    labelled, unlabelled = _rich_rows(spark, folder)
    train = models.training_table(labelled, KEY, FEATURES, "session_value")
    return train, models.score_table(unlabelled, KEY, FEATURES)


def _submission(predicted):
    return score.clip_predictions(
        predicted.select(KEY, F.col("prediction").alias("session_value")), "session_value"
    )


@query(
    "linear_fit_one_feature",
    EVENTS_SQL
    + f"""
, b AS (SELECT user_session, max(session_value) AS y, count(*) AS x FROM ev GROUP BY user_session),
f AS (SELECT regr_slope(y, x) AS m, regr_intercept(y, x) AS i FROM b WHERE y IS NOT NULL)
SELECT user_session, round(i + m * x + {TIE_SHIFT}, 6) AS session_value FROM b, f
WHERE y IS NULL""",
)
def linear_fit_one_feature(spark, folder):
    sessions = basic_features(session_events(spark, folder))
    train = models.training_table(sessions, KEY, ["event_count"], "session_value")
    unlabelled = sessions.where(F.col("session_value").isNull())
    scoring = models.score_table(unlabelled, KEY, ["event_count"])
    fitted = models.linear(solver="normal").fit(train)
    predicted = fitted.transform(scoring)
    return rounded(predicted.select(KEY, F.col("prediction").alias("session_value")))


BASIC_SQL = """
, base AS (SELECT user_session, count(DISTINCT event_type) AS unique_event_types,
  count(DISTINCT product_id) AS unique_products, count(DISTINCT category_id) AS unique_categories,
  count(event_time) AS event_count, max(session_value) AS session_value FROM ev GROUP BY user_session)"""
IN_TRAINING_SQL = f"{key_hash_sql('user_session', 42)} % 100 >= 20"
CLEAN_RICH_SQL = (
    RICH_SQL
    + """,
q AS (SELECT quantile_cont(session_value, 0.25) AS q1, quantile_cont(session_value, 0.75) AS q3 FROM rich),
clean AS (SELECT rich.* FROM rich, q
  WHERE session_value IS NULL OR session_value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))"""
)


def _features_sql(features):
    return ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}" for c in features)


def _fitted_sql(source, features, fit):
    """Predictions of sessions without a label, from those with one for which ``fit`` holds."""
    return (
        f""",
ls0 AS (SELECT 0 AS g, user_session AS id, session_value IS NOT NULL AND {fit} AS fit,
  {_features_sql(features)}, session_value AS y FROM {source}),
"""
        + least_squares_sql(features)
        + f"""
SELECT id AS user_session, {sql_rounded(["session_value"])}
FROM (SELECT id, greatest(prediction, 0) AS session_value FROM fitted WHERE y IS NULL)"""
    )


def _linear_submission(labelled, unlabelled, features):
    """Least squares on the labelled sessions outside the hold-out, applied to the others."""
    kept = models.hash_split(labelled, KEY).where(~F.col("is_validation"))
    fit = leastsq.fit_linear(kept, features, "session_value")
    predicted = unlabelled.select(KEY, fit.prediction().alias("prediction"))
    return rounded(_submission(predicted))


@query("lr_scores", EVENTS_SQL + BASIC_SQL + _fitted_sql("base", BASIC, IN_TRAINING_SQL))
def lr_scores(spark, folder):
    sessions = basic_features(session_events(spark, folder))
    sessions = files.stage(sessions, fresh_path(spark, "sessions"))
    label = F.col("session_value")
    return _linear_submission(sessions.where(label.isNotNull()), sessions.where(label.isNull()), BASIC)


@query(
    "lr_scores_full",
    EVENTS_SQL + CLEAN_RICH_SQL + _fitted_sql("clean", FEATURES, IN_TRAINING_SQL),
)
def lr_scores_full(spark, folder):
    return _linear_submission(*_rich_rows(spark, folder), FEATURES)


@query("rf_scores")
def rf_scores(spark, folder):
    train, scoring = _rich(spark, folder)
    fitted = models.fit_models(train, {"forest": models.forest()})
    return _submission(fitted["forest"].transform(scoring))


@query("extra_trees_scores")
def extra_trees_scores(spark, folder):
    labelled, unlabelled = _rich_rows(spark, folder)
    split = models.hash_split(labelled, KEY).where(~F.col("is_validation")).na.fill(0, FEATURES)
    model = fit_extra_trees(cut_lineage(split.select(*FEATURES, "session_value")), FEATURES, "session_value")
    return _submission(unlabelled.na.fill(0, FEATURES).withColumn("prediction", model.prediction()))


@query("gbt_scores")
def gbt_scores(spark, folder):
    train, scoring = _rich(spark, folder)
    fitted = models.fit_models(train, {"boosted": models.boosted(early_stop=True)})
    return _submission(fitted["boosted"].transform(scoring))


CATEGORY_SQL = (
    EVENTS_SQL
    + BASIC_SQL
    + f""",
cats AS (SELECT user_session, category_id AS main_category FROM (SELECT user_session, category_id,
    row_number() OVER (PARTITION BY user_session ORDER BY count(*) DESC, category_id) AS r
  FROM ev GROUP BY user_session, category_id) WHERE r = 1),
s AS (SELECT user_session, main_category, session_value AS y, {key_hash_sql('user_session', 42)} AS place
  FROM base LEFT JOIN cats USING (user_session)),
means AS (SELECT user_session, main_category, (SELECT avg(y) FROM s) AS mean,
  CASE WHEN y IS NULL THEN sum(y) OVER (PARTITION BY main_category) ELSE sum(y) OVER earlier END AS total,
  CASE WHEN y IS NULL THEN count(y) OVER (PARTITION BY main_category) ELSE count(y) OVER earlier END AS n
  FROM s WINDOW earlier AS (PARTITION BY main_category ORDER BY place
    RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_session, main_category,
  round((coalesce(total, 0) + mean) / (n + 1) + {TIE_SHIFT}, 6) AS category_mean FROM means"""
)


def _category_means(spark, folder):
    events = staged_events(spark, folder)
    rows = attach(basic_features(events), main_value(events, KEY, "category_id", "main_category"), KEY)
    return history.ordered_target_mean(rows, KEY, "main_category", "session_value", "category_mean")


@query("ordered_category_means", CATEGORY_SQL)
def ordered_category_means(spark, folder):
    return rounded(_category_means(spark, folder).select(KEY, "main_category", "category_mean"))


@query("gbt_category_scores")
def gbt_category_scores(spark, folder):
    rows = files.stage(_category_means(spark, folder), fresh_path(spark, "sessions"))
    features, label = [*BASIC, "category_mean"], F.col("session_value")
    train = models.training_table(rows.where(label.isNotNull()), KEY, features, "session_value")
    fitted = models.fit_models(train, {"boosted": models.boosted(early_stop=True)})
    return _submission(fitted["boosted"].transform(models.score_table(rows.where(label.isNull()), KEY, features)))


VARIANTS = {"counts": ["event_count"], "basic": BASIC}
FILE_TO_FILE_SQL = (
    EVENTS_SQL
    + BASIC_SQL
    + f""",
ls0 AS (SELECT g, user_session AS id, session_value IS NOT NULL AND {IN_TRAINING_SQL} AS fit,
  {", ".join(f"CAST({c} * {'1' if c == 'event_count' else 'g'} AS DOUBLE) AS {c}" for c in BASIC)}, session_value AS y
  FROM base, (VALUES (0), (1)) v(g)),
"""
    + least_squares_sql(BASIC)
    + f""",
errors AS (SELECT g, sqrt(avg((y - prediction) ** 2)) AS rmse FROM fitted
  WHERE y IS NOT NULL AND NOT ({IN_TRAINING_SQL.replace("user_session", "id")}) GROUP BY g),
long AS (SELECT id, g, rmse, prediction FROM fitted JOIN errors USING (g) WHERE y IS NULL),
out AS (
  SELECT 'best_single' AS variant, id, arg_min(prediction, (rmse, g)) AS p FROM long GROUP BY id
  UNION ALL SELECT 'ensemble_simple', id, avg(prediction) FROM long GROUP BY id
  UNION ALL SELECT 'ensemble_weighted', id, sum(prediction / rmse) / sum(1 / rmse) FROM long GROUP BY id)
SELECT variant, id AS user_session, round(greatest(p, 0) + {TIE_SHIFT}, 6) AS session_value FROM out"""
)


@query("file_to_file", FILE_TO_FILE_SQL)
def file_to_file(spark, folder):
    """From event files to prediction files: read, sum up sessions, fit two linear models outside the
    hold-out, compare them there, clip, write best, mean and weighted mean, read back."""
    events = files.read_events(spark, _event_csv(spark, folder))
    sessions = basic_features(events.withColumn("event_id", F.monotonically_increasing_id()))
    sessions = models.hash_split(files.stage(sessions, fresh_path(spark, "sessions")), KEY)
    labelled = sessions.where(F.col("session_value").isNotNull())
    train, held_out = labelled.where(~F.col("is_validation")), labelled.where("is_validation")
    fits = {name: leastsq.fit_linear(train, features, "session_value") for name, features in VARIANTS.items()}

    def long(rows):
        each = [F.struct(F.lit(n).alias("model"), f.prediction().alias("prediction")) for n, f in fits.items()]
        return rows.select(KEY, "session_value", F.inline(F.array(*each)))

    scores = score.metrics(long(held_out), "session_value", "prediction", ["model"])
    scores = files.stage(scores, fresh_path(spark, "scores"))
    predicted = long(sessions.where(F.col("session_value").isNull())).drop("session_value")
    best = attach(score.best_model(scores).select("model"), predicted, "model").select(KEY, "prediction")
    variants = {
        "best_single": best,
        "ensemble_simple": score.ensemble_mean(predicted, KEY, "prediction"),
        "ensemble_weighted": score.blend(predicted, score.inverse_error_weights(scores), KEY, "prediction"),
    }
    base = fresh_path(spark, "submissions")
    for name, rows in variants.items():
        files.write_predictions(_submission(rows), f"{base}/submission_{name}.csv")
    schema = T.StructType([T.StructField(KEY, T.StringType()), T.StructField("session_value", T.DoubleType())])
    back = files.read_many(spark, f"{base}/submission_*.csv", schema)
    variant = F.regexp_extract("file_path", r"submission_(\w+)\.csv", 1).alias("variant")
    return rounded(back.select(variant, KEY, "session_value"))


FOLDS = 5
FOLD_SQL = (
    EVENTS_SQL
    + CLEAN_RICH_SQL
    + f""",
ls0 AS (SELECT g, user_session AS id, {key_hash_sql("user_session", 43)} % {FOLDS} <> g AS fit,
  {_features_sql(FEATURES)}, session_value AS y
  FROM clean, range(0, {FOLDS}) f(g) WHERE session_value IS NOT NULL),
"""
    + least_squares_sql(FEATURES)
    + f""",
folds AS (SELECT CAST(g AS INTEGER) AS fold, sqrt(avg((y - prediction) ** 2)) AS rmse FROM fitted
  WHERE {key_hash_sql("id", 43)} % {FOLDS} = g GROUP BY g)
"""
)


def _fold_scores(spark, folder):
    labelled, _ = _rich_rows(spark, folder)
    dealt = labelled.withColumn("fold", models.split_bucket(KEY, 43, FOLDS))
    return leastsq.linear_fold_scores(dealt, FEATURES, "session_value", "fold")


@query("cv_fold_scores", FOLD_SQL + f"SELECT fold, {sql_rounded(['rmse'])} FROM folds")
def cv_fold_scores(spark, folder):
    return rounded(_fold_scores(spark, folder))


@query(
    "cv_scores",
    FOLD_SQL
    + "SELECT round(avg(rmse) + 3e-9, 6) AS rmse_mean, round(stddev_pop(rmse) + 3e-9, 6) AS rmse_std FROM folds",
)
def cv_scores(spark, folder):
    return rounded(
        _fold_scores(spark, folder).agg(
            F.avg("rmse").alias("rmse_mean"), F.stddev_pop("rmse").alias("rmse_std")
        )
    )


@query(
    "cv_scores_one_feature",
    EVENTS_SQL
    + f"""
, b AS (SELECT user_session, max(session_value) AS y, count(*) AS x,
               {key_hash_sql("user_session", 43)} % 3 AS fold
        FROM ev WHERE split = 'train' GROUP BY user_session),
m AS (SELECT f.fold, regr_slope(y, x) AS m, regr_intercept(y, x) AS i
      FROM b, (SELECT DISTINCT fold FROM b) f WHERE b.fold <> f.fold GROUP BY f.fold),
e AS (SELECT fold, sqrt(avg((y - i - m * x) ** 2)) AS rmse FROM b JOIN m USING (fold)
      GROUP BY fold)
SELECT round(avg(rmse) + 3e-9, 6) AS rmse_mean, round(stddev_pop(rmse) + 3e-9, 6) AS rmse_std
FROM e""",
)
def cv_scores_one_feature(spark, folder):
    sessions = basic_features(session_events(spark, folder))
    train = models.training_table(sessions, KEY, ["event_count"], "session_value")
    return rounded(models.cross_validate(train, models.linear(solver="normal"), 3))


@query("random_search_scores")
def random_search_scores(spark, folder):
    train, _ = _basic(spark, folder)
    return models.random_search(train, models.forest(), GRID, n=4)[1]


@query("holdout_search_scores")
def holdout_search_scores(spark, folder):
    train, _ = _basic(spark, folder)
    return models.holdout_search(train, models.boosted(), BOOST_GRID, n=4)[1]


SPECS = {
    "linear": models.linear,
    "forest": models.forest,
    "boosted": models.boosted,
}


SELECTION_STEPS = 10


def _selection_sql(models, steps=SELECTION_STEPS):
    """Every step of the selection as a common table expression over the mean error products."""
    pairs = [(a, b) for a in models for b in models]
    products = ", ".join(
        f"avg((session_value - {a}) * (session_value - {b})) AS {a}_{b}" for a, b in pairs
    )
    formulas = ", ".join(f"CAST({f} AS DOUBLE) AS {n}" for n, f in FORMULAS.items())
    ctes = [
        f"wide AS (SELECT session_value, {formulas} FROM base WHERE split = 'train')",
        f"products AS (SELECT {products} FROM wide)",
        "t0 AS (SELECT " + ", ".join(f"0 AS {m}" for m in models) + ")",
    ]
    for step in range(1, steps + 1):
        tries = []
        for i, name in enumerate(models):
            count = {m: f"(t.{m} + {int(m == name)})" for m in models}
            error = " + ".join(f"{count[a]} * {count[b]} * {a}_{b}" for a, b in pairs)
            tries.append(
                f"SELECT {i} AS k, round(({error}) / {step * step}.0, 9) AS e, "
                + ", ".join(f"{count[m]} AS {m}" for m in models)
                + f" FROM t{step - 1} t, products"
            )
        ctes.append(f"t{step} AS (SELECT {', '.join(models)} FROM ({' UNION ALL '.join(tries)}) ORDER BY e, k LIMIT 1)")
    out = " UNION ALL ".join(
        f"SELECT '{m}' AS model, CAST({m} AS INTEGER) AS taken, CAST({m} AS DOUBLE) / {steps} AS weight FROM t{steps}"
        for m in models
    )
    return ", " + ", ".join(ctes) + " " + out


@query("ensemble_selection", EVENTS_SQL + LONG_SQL + _selection_sql(list(FORMULAS)))
def ensemble_selection(spark, folder):
    base = basic_features(train_part(session_events(spark, folder)))
    wide = base.select("session_value", *[F.expr(f).cast("double").alias(n) for n, f in FORMULAS.items()])
    return score.selection_weights(wide, list(FORMULAS), "session_value", SELECTION_STEPS)


@query("automl_leaderboard")
def automl_leaderboard(spark, folder):
    """Weights of the ensemble come from out-of-fold predictions of the training rows; the hold-out is
    only scored."""
    labelled, _ = _rich_rows(spark, folder)
    table = models.training_table(labelled, KEY, FEATURES, "session_value", folds=FOLDS)
    train, held_out = table.where(~F.col("is_validation")), table.where("is_validation")
    specs = {name: make() for name, make in SPECS.items()}
    unseen = models.out_of_fold(train, specs, FOLDS, ["label"])
    weights = score.selection_weights(unseen, list(specs), "label", SELECTION_STEPS)
    fitted = models.fit_models(table, specs)
    predicted = models.predict_long(fitted, held_out, [KEY, "label"])
    single = score.metrics(predicted, "label", "prediction", ["model"])
    blended = score.blend(predicted.select(KEY, "model", "prediction"), weights, KEY, "prediction")
    blended = attach(blended, held_out.select(KEY, "label"), KEY).withColumn("model", F.lit("weighted ensemble"))
    together = score.metrics(blended, "label", "prediction", ["model"])
    return score.leaderboard(single.unionByName(together))


@query("feature_importance")
def feature_importance(spark, folder):
    train, _ = _rich(spark, folder)
    fitted = models.fit_models(train, {"forest": models.forest()})
    return models.importances(fitted["forest"], FEATURES, spark)


PERMUTED_SQL = (
    EVENTS_SQL
    + CLEAN_RICH_SQL
    + f""",
held AS (SELECT user_session, {_features_sql(FEATURES)}, session_value,
    row_number() OVER (ORDER BY {key_hash_sql("user_session", 42)}, user_session) - 1 AS at, count(*) OVER () AS n
  FROM clean WHERE session_value IS NOT NULL AND NOT ({IN_TRAINING_SQL})),
ls0 AS (
  SELECT 0 AS g, 'fit' AS id, true AS fit, {_features_sql(FEATURES)}, session_value AS y FROM clean
  WHERE session_value IS NOT NULL AND {IN_TRAINING_SQL}
  UNION ALL SELECT 0, 'plain', false, {", ".join(FEATURES)}, session_value FROM held
  """
    + "\n  ".join(
        f"UNION ALL SELECT 0, '{c}', false, {', '.join(('b.' if f == c else 'a.') + f for f in FEATURES)}, a.session_value"
        f" FROM held a JOIN held b ON b.at = (a.at + 1 + {key_hash_sql(f"'{c}'", 42)} % (a.n - 1)) % a.n"
        for c in FEATURES
    )
    + "),\n"
    + least_squares_sql(FEATURES)
    + """,
errors AS (SELECT id, sqrt(avg((y - prediction) ** 2)) AS rmse FROM fitted WHERE id <> 'fit' GROUP BY id)
SELECT id AS feature, round(rmse + 3e-9, 6) AS rmse,
  round(rmse - (SELECT rmse FROM errors WHERE id = 'plain') + 3e-9, 6) AS rise
FROM errors WHERE id <> 'plain'"""
)


@query("permutation_importance_linear", PERMUTED_SQL)
def permutation_importance_linear(spark, folder):
    labelled, _ = _rich_rows(spark, folder)
    split = models.hash_split(labelled.na.fill(0, FEATURES), KEY)
    fit = leastsq.fit_linear(split.where(~F.col("is_validation")), FEATURES, "session_value")
    return rounded(
        models.permutation_importance(
            split.where("is_validation"), KEY, FEATURES, "session_value",
            lambda rows: rows.withColumn("prediction", fit.prediction()),
        )
    )


@query("permutation_importance")
def permutation_importance(spark, folder):
    labelled, _ = _rich_rows(spark, folder)
    split = models.hash_split(labelled.na.fill(0, FEATURES), KEY)
    train = feature_vector(split.where(~F.col("is_validation")), FEATURES)
    fitted = models.forest(labelCol="session_value").fit(cut_lineage(train.select("features", "session_value")))
    return models.permutation_importance(
        split.where("is_validation"), KEY, FEATURES, "session_value",
        lambda rows: fitted.transform(feature_vector(rows, FEATURES)),
    ).orderBy(F.desc("rise"), "feature")


@query("kmeans_segments")
def kmeans_segments(spark, folder):
    sessions = rich(staged_events(spark, folder))
    return models.kmeans_segments(sessions, KEY, FEATURES, k=8, seeds=10)


@query("seed_bagging")
def seed_bagging(spark, folder):
    train, scoring = _basic(spark, folder)

    def make(seed):
        return models.forest(seed=seed, trees=5, depth=4)

    return models.seed_bagging(train, scoring, make, BAGGING_SEEDS, KEY)


@query("refit_and_score")
def refit_and_score(spark, folder):
    train, scoring = _rich(spark, folder)
    specs = {"linear": models.linear(), "forest": models.forest()}
    best = [r["model"] for r in models.compare_models(train, specs).limit(2).collect()]
    fitted = models.refit(train, {name: specs[name] for name in best})
    predicted = models.predict_long(fitted, scoring, [KEY])
    return score.clip_predictions(score.ensemble_mean(predicted, KEY, "prediction"), "prediction")


@query("saved_model_scores")
def saved_model_scores(spark, folder):
    sessions = basic_features(session_events(spark, folder))
    train = sessions.where(F.col("session_value").isNotNull())
    path = fresh_path(spark, "model")
    loaded = models.save_pipeline(train, BASIC, models.linear(labelCol="session_value"), path)
    scored = loaded.transform(sessions.where(F.col("session_value").isNull()))
    return _submission(scored)
