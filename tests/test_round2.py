"""Ordinary event files, null keys, early-stopped boosting and long chains of merges."""

from datetime import datetime

from pyspark.sql import functions as F

from sessionloom.operators import history, models, textsim
from sessionloom.sources import files, fixtures


def test_event_files_in_any_usual_form(spark, tmp_path):
    lines = [
        "user_session,event_time,user_id,event_type,session_value,product_id",
        "s1,2025-06-19 10:23:07,u1,BUY,1.5,p1",
        "s1,2025-06-19T10:23:07,u1,VIEW,NaN,p1",
        "s2,2025-06-19T10:23:07.250000,u2,VIEW,inf,p1",
        "s2,2025-06-19 10:23:07+02:00,u2,VIEW,,p2",
        "s3,2025-06-19 10:23:07 UTC,,VIEW,2,p2",
        "s3,yesterday,u3,VIEW,2,p2",
    ]
    (tmp_path / "log.csv").write_text("\n".join(lines) + "\n")
    rows = files.read_events(spark, str(tmp_path / "log.csv")).collect()
    noon = datetime(2025, 6, 19, 10, 23, 7)
    assert [r.event_time for r in rows] == [
        noon, noon, noon.replace(microsecond=250000), noon.replace(hour=8), noon, None
    ]
    assert [r.session_value for r in rows] == [1.5, None, None, None, 2.0, 2.0]
    assert [r.user_session for r in rows] == ["s1", "s1", "s2", "s2", "s3", "s3"]
    assert {r.category_id for r in rows} == {None} and rows[4].user_id is None
    assert files.unparsed_times(spark, str(tmp_path / "log.csv")) == 1


def test_null_keys_are_no_group(spark):
    rows = [("A", "BUY")] * 2 + [(None, "BUY")] * 4 + [("B", "BUY")] * 2
    df = spark.createDataFrame(rows, "category_id string, event_type string")
    assert {r.category_id: r.category_popularity for r in history.category_popularity(df).collect()} == {"A": 2, "B": 2}


def test_events_without_user_stay(spark):
    df = spark.range(100).select(
        F.when(F.col("id") % 10 > 0, F.col("id") % 7).alias("user_id"),
        F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("ts"),
        F.lit(1.0).alias("value"),
    )
    out = fixtures.number_sessions(df, "user_id", "ts", totals={"total": F.col("value")})
    assert out.count() == 100 and out.where("user_id IS NULL").count() == 10


def test_refit_of_boosting_that_stops_early(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    df = spark.range(200).select(
        (F.col("id") % 13).cast("double").alias("x"), (F.col("id") % 13 * 2).cast("double").alias("label"),
        (F.col("id") % 5 == 0).alias("is_validation"),
    )
    train = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    spec = GBTRegressor(maxIter=5, maxDepth=2, validationIndicatorCol="is_validation")
    fitted = models.refit(train, {"boosted": spec})["boosted"]
    assert 1 <= fitted.getNumTrees <= 5
    assert spec.isSet("validationIndicatorCol")


def test_clustering_has_no_round_limit():
    import inspect

    assert list(inspect.signature(textsim.linkage_clusters).parameters) == ["weights", "threshold"]


def _trees(spark):
    rows = [(i, float(i % 7), float(i % 3), float(i % 7 + i % 3)) for i in range(120)]
    df = spark.createDataFrame(rows, "key long, x double, y double, label double")
    return models.training_table(df, "key", ["x", "y"], "label")


def test_bagging_is_the_mean_of_its_models(spark):
    train = _trees(spark)

    def make(seed):
        return models.forest(seed=seed, trees=3, depth=3)

    seeds = [1, 2, 3]
    got = {r["key"]: r["prediction"] for r in models.seed_bagging(train, train, make, seeds, "key").collect()}
    fitted = {str(seed): make(seed).fit(train) for seed in seeds}
    single = models.predict_long(fitted, train, ["key"])
    assert single.count() == 3 * len(got)
    for r in single.groupBy("key").agg(F.avg("prediction").alias("mean")).collect():
        assert abs(got[r["key"]] - r["mean"]) < 1e-9
    alone = {r["key"]: r["prediction"] for r in fitted["2"].transform(train).collect()}
    assert {r["key"]: r["prediction"] for r in single.where("model = '2'").collect()} == alone


def test_holdout_search_keeps_to_the_flag(spark):
    train = _trees(spark)
    grid = {"maxDepth": [1, 3], "numTrees": [2, 4]}
    tables = [
        models.holdout_search(df, models.forest(), grid, n=4)[1].collect()
        for df in (train, train)
    ]
    assert tables[0] == tables[1] and len(tables[0]) == 4
    assert tables[0][0]["rmse"] == min(r["rmse"] for r in tables[0])


def test_equal_frequencies_have_no_spread(spark):
    rows = [("s1", "a", "p"), ("s1", "b", "p"), ("s1", "c", "q"), ("s2", "a", None), (None, "a", "p")]
    events = spark.createDataFrame(rows, "user_session string, a string, b string")
    train = spark.createDataFrame([("s", v, "p") for v in "abc"], "user_session string, a string, b string")
    found = history.frequency_session_stats(events, train, ["a", "b"]).collect()
    by = {r["user_session"]: r for r in found}
    assert set(by) == {"s1", "s2"} and by["s1"]["a_freq_std"] == 0.0
    assert by["s1"]["b_freq_mean"] == 2 / 3 and by["s1"]["b_freq_max"] == 1.0
    assert by["s2"]["b_freq_sum"] == 0.0 and by["s2"]["b_freq_std"] is None
