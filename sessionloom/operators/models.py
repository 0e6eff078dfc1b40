"""Training, search, segmentation and scoring with Spark ML."""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.cluster import cut_lineage
from sessionloom.functions.ratios import key_hash
from sessionloom.operators.encode import feature_vector, standardize
from sessionloom.operators.positions import number_in_order
from sessionloom.operators.score import leaderboard, metrics



def split_bucket(key: str, seed: int, buckets: int):
    """Stable bucket of a key; rows with one key never end up on both sides of a split."""
    return F.pmod(key_hash(key, seed), F.lit(buckets)).cast("int")


def fit_side_by_side(session: SparkSession, fit, items: list, parallelism: int = 4) -> list:
    """Run independent fits at the same time, as the tuners do: small jobs fill the cluster."""
    with ThreadPool(min(parallelism, len(items))) as pool:
        return pool.map(inheritable_thread_target(session)(fit), items)


def hash_split(df: DataFrame, key: str, seed: int = 42, pct: int = 20, to: str = "is_validation"):
    """Flag about ``pct`` percent of the keys as validation."""
    return df.withColumn(to, split_bucket(key, seed, 100) < pct)


def training_table(
    df: DataFrame, key: str, features: list[str], label: str, seed: int = 42, folds: int = 3
) -> DataFrame:
    """Features as a vector, label, validation flag and fold, written once before the iterations."""
    ready = hash_split(df.where(F.col(label).isNotNull()), key, seed)
    ready = ready.withColumns({"fold": split_bucket(key, seed + 1, folds), "label": F.col(label)})
    ready = feature_vector(ready.na.fill(0, features), features)
    return cut_lineage(ready.select(key, "features", "label", "is_validation", "fold"))


def score_table(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    return feature_vector(df.na.fill(0, features), features).select(key, "features")


def linear(**options) -> LinearRegression:
    return LinearRegression(**options)


def forest(seed: int = 42, trees: int = 20, depth: int = 6, **options) -> RandomForestRegressor:
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed, **options)


def boosted(
    seed: int = 42, rounds: int = 20, depth: int = 4, step: float = 0.1, early_stop: bool = False,
    **options,
) -> GBTRegressor:
    """Boosted trees; with ``early_stop`` the validation rows decide when to end."""
    model = GBTRegressor(maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed, **options)
    return model.setValidationIndicatorCol("is_validation") if early_stop else model


def fit_models(train: DataFrame, specs: dict[str, Estimator]) -> dict:
    """Fit each estimator on the rows that are not held out (early stopping needs both)."""
    rest = train.where(~F.col("is_validation"))
    return {
        name: spec.fit(
            train
            if spec.hasParam("validationIndicatorCol") and spec.isSet("validationIndicatorCol")
            else rest
        )
        for name, spec in specs.items()
    }


def predict_wide(models: list, df: DataFrame) -> tuple[DataFrame, list[str]]:
    """One prediction column per model beside the columns of ``df``, in one pass, and their names."""
    names = [f"_prediction_{i}" for i in range(len(models))]
    for model, name in zip(models, names):
        df = model.transform(df, {model.predictionCol: name})
    return df, names


def predict_long(models: dict, df: DataFrame, keep: list[str]) -> DataFrame:
    """Predictions of all models in one long table with the model's name; ``df`` is read once."""
    wide, columns = predict_wide(list(models.values()), df)
    rows = [
        F.struct(F.lit(name).alias("model"), F.col(column).alias("prediction"))
        for name, column in zip(models, columns)
    ]
    return wide.select(*keep, F.inline(F.array(*rows)))


def model_scores(models: dict, train: DataFrame) -> DataFrame:
    """Hold-out metrics of fitted models."""
    held_out = train.where("is_validation")
    return metrics(predict_long(models, held_out, ["label"]), "label", "prediction", ["model"])


def compare_models(train: DataFrame, specs: dict[str, Estimator]) -> DataFrame:
    return leaderboard(model_scores(fit_models(train, specs), train))


def fold_scores(train: DataFrame, spec: Estimator, folds: int) -> DataFrame:
    """RMSE of each fold, fitted on the others."""
    predicted = None
    for fold in range(folds):
        model = spec.fit(train.where(F.col("fold") != fold))
        part = model.transform(train.where(F.col("fold") == fold)).select("fold", "label", "prediction")
        predicted = part if predicted is None else predicted.unionByName(part)
    return metrics(predicted, "label", "prediction", ["fold"])


def cross_validate(train: DataFrame, spec: Estimator, folds: int) -> DataFrame:
    """Mean and population deviation of the fold RMSEs."""
    return fold_scores(train, spec, folds).agg(
        F.avg("rmse").alias("rmse_mean"), F.stddev_pop("rmse").alias("rmse_std")
    )


def draw_grid(spec: Estimator, grid: dict[str, list], n: int, seed: int) -> list[dict]:
    """n different settings drawn from a grid, as parameter maps."""
    names = list(grid)
    settings = list(itertools.product(*[grid[name] for name in names]))
    drawn = random.Random(seed).sample(settings, min(n, len(settings)))
    return [{spec.getParam(name): value for name, value in zip(names, s)} for s in drawn]


def _search_table(train: DataFrame, maps: list[dict], scores: list[float]) -> DataFrame:
    rows = [
        (i, ", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda e: e[0].name)), float(s))
        for i, (m, s) in enumerate(zip(maps, scores))
    ]
    table = train.sparkSession.createDataFrame(rows, "trial int, settings string, rmse double")
    return table.orderBy("rmse", "trial")


def random_search(
    train: DataFrame, spec: Estimator, grid: dict[str, list], n: int, seed: int = 42, folds: int = 3,
    parallelism: int = 4,
):
    """Best of n drawn settings by k-fold RMSE: (model, table of trials)."""
    maps = draw_grid(spec, grid, n, seed)
    search = CrossValidator(
        estimator=spec, estimatorParamMaps=maps, evaluator=RegressionEvaluator(metricName="rmse"),
        numFolds=folds, foldCol="fold", parallelism=parallelism,
    ).fit(train)
    return search.bestModel, _search_table(train, maps, search.avgMetrics)


def holdout_search(
    train: DataFrame, spec: Estimator, grid: dict[str, list], n: int, seed: int = 42,
    parallelism: int = 4,
):
    """Best of n drawn settings on the rows flagged as validation: (model, table of trials).

    The flag belongs to the key, so trials repeat under any partitioning; the model is fitted on all
    rows with the best settings.
    """
    maps = draw_grid(spec, grid, n, seed)
    rest, held_out = train.where(~F.col("is_validation")), train.where("is_validation")
    rmse = RegressionEvaluator(metricName="rmse")
    errors = fit_side_by_side(
        train.sparkSession,
        lambda settings: rmse.evaluate(spec.fit(rest, settings).transform(held_out)),
        maps, parallelism,
    )
    best = min(range(len(maps)), key=lambda i: (errors[i], i))
    return spec.fit(train, maps[best]), _search_table(train, maps, errors)


def refit(train: DataFrame, specs: dict[str, Estimator]) -> dict:
    """Fit on all labelled rows; boosting that stops early keeps the number of trees it found."""
    return {name: _whole(spec, train).fit(train) for name, spec in specs.items()}


def _whole(spec: Estimator, train: DataFrame) -> Estimator:
    if not (spec.hasParam("validationIndicatorCol") and spec.isSet("validationIndicatorCol")):
        return spec
    whole = spec.copy({spec.maxIter: spec.fit(train).getNumTrees})
    whole.clear(whole.validationIndicatorCol)
    return whole


def importances(model, features: list[str], spark) -> DataFrame:
    """Impurity importance or absolute coefficient of each feature, strongest first."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    else:
        values = abs(model.coefficients.toArray())
    rows = [(name, float(v)) for name, v in zip(features, values)]
    table = spark.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature")


def permutation_importance(
    held_out: DataFrame, key: str, features: list[str], label: str,
    predict: Callable[[DataFrame], DataFrame], seed: int = 42,
) -> DataFrame:
    """``feature, rmse, rise``: the error when a feature's values are dealt to other rows, and how far
    that is above the error on the rows as they are.

    Rows get a position in the order of a seeded hash of their key. A feature's values move along
    that order by a step of its own (a seeded hash of its name, at least 1), so every value is used
    once and none stays. All moved values meet their rows in one aggregation, and all versions of all
    rows are scored in one pass by ``predict``, which adds ``prediction``. With one row nothing can
    move and every rise is 0.
    """
    hashed = held_out.select(
        F.struct(key_hash(key, seed).alias("hash"), F.col(key).alias("key")).alias("_order"),
        F.col(label).cast("double").alias("_label"),
        *[F.col(c).cast("double").alias(c) for c in features],
    )
    placed = cut_lineage(number_in_order(hashed, "_order", "_at"))
    n = placed.count()
    steps = [F.when(F.lit(n > 1), 1 + F.pmod(key_hash(F.lit(c), seed), F.lit(max(n - 1, 1)))).otherwise(0)
             for c in features]
    moves = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.pmod(F.col("_at") - step, F.lit(max(n, 1))).alias("to"), F.col(c).alias("value"))
            for i, (c, step) in enumerate(zip(features, steps))
        ]
    )
    moved = placed.select(F.inline(moves)).groupBy(F.col("to").alias("_at")).agg(
        *[F.max(F.when(F.col("i") == i, F.col("value"))).alias(f"_new{i}") for i in range(len(features))]
    )
    versions = placed.join(moved, "_at").withColumn("_i", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))))
    versions = versions.select(
        "_i", "_label",
        *[F.when(F.col("_i") == i, F.col(f"_new{i}")).otherwise(F.col(c)).alias(c) for i, c in enumerate(features)],
    )
    error = F.col("_label") - F.col("prediction")
    scores = predict(versions).groupBy("_i").agg(F.sqrt(F.avg(error * error)).alias("rmse"))
    plain = F.max(F.when(F.col("_i") == -1, F.col("rmse"))).over(W.partitionBy(F.lit(0)))  # one row a feature
    names = F.array(*[F.lit(c) for c in features])
    return (
        scores.withColumn("rise", F.col("rmse") - plain)
        .where("_i >= 0")
        .select(F.element_at(names, F.col("_i") + 1).alias("feature"), "rmse", "rise")
    )


def out_of_fold(
    train: DataFrame, specs: dict[str, Estimator], folds: int, keep: list[str], parallelism: int = 4
) -> DataFrame:
    """One column of predictions per model beside ``keep``; each row is predicted by fits that have
    not seen its fold."""
    jobs = [(fold, name) for fold in range(folds) for name in specs]
    fitted = dict(
        zip(
            jobs,
            fit_side_by_side(
                train.sparkSession, lambda job: specs[job[1]].fit(train.where(F.col("fold") != job[0])),
                jobs, parallelism,
            ),
        )
    )
    parts = []
    for fold in range(folds):
        wide, columns = predict_wide([fitted[fold, name] for name in specs], train.where(F.col("fold") == fold))
        parts.append(wide.select(*keep, *[F.col(c).alias(name) for c, name in zip(columns, specs)]))
    return reduce(DataFrame.unionByName, parts)


def _nearest(centers: list[list[list[float]]], point: Column) -> Column:
    """For every start the squared distance to its nearest centre and the number of that centre."""
    tables = F.from_json(F.lit(json.dumps(centers)), "array<array<array<double>>>")

    def distance(centre):
        squares = F.zip_with(centre, point, lambda a, b: (a - b) * (a - b))
        return F.aggregate(squares, F.lit(0.0), lambda total, x: total + x)

    return F.transform(
        tables,
        lambda own: F.array_min(
            F.transform(own, lambda centre, i: F.struct(distance(centre).alias("distance"), i.alias("cluster")))
        ),
    )


def kmeans_starts(
    points: DataFrame, key: str, k: int, seeds: int, seed: int = 42, rounds: int = 20, least_move: float = 1e-4
) -> tuple[list[list[list[float]]], list[float]]:
    """Centres and summed squared distances of several starts of k-means over ``key, point``.

    A start begins with the k rows that have the smallest seeded hash of their key. Every round assigns
    the rows for all starts and adds them up in one scan; only one row for each centre reaches the
    driver. A centre without rows stays. With fewer than k rows there are fewer centres; without rows none.
    """
    width = len((points.select("point").first() or [[]])[0])
    first = [
        points.select(F.lit(i).alias("start"), "point", key_hash(key, seed + i).alias("place"), F.col(key).alias("key"))
        .orderBy("place", "key").limit(k)
        for i in range(seeds)
    ]
    centers: list[list[list[float]]] = [[] for _ in range(seeds)]
    for row in reduce(DataFrame.unionAll, first).orderBy("start", "place", "key").collect():  # seeds * k rows
        centers[row["start"]].append(list(row["point"]))

    def summed(now):
        hits = points.select("point", F.posexplode(_nearest(now, F.col("point"))).alias("start", "hit"))
        return hits.groupBy("start", F.col("hit.cluster").alias("cluster")).agg(
            F.count("*").alias("n"), F.sum("hit.distance").alias("cost"),
            F.array(*[F.sum(F.col("point")[j]) for j in range(width)]).alias("sums"),
        ).collect()  # seeds * k rows

    for _ in range(rounds if width else 0):
        moved = 0.0
        for row in summed(centers):
            new = [x / row["n"] for x in row["sums"]]
            old = centers[row["start"]][row["cluster"]]
            moved = max(moved, sum((a - b) ** 2 for a, b in zip(new, old)) ** 0.5)
            centers[row["start"]][row["cluster"]] = new
        if moved <= least_move:
            break
    costs = [0.0] * seeds
    for row in summed(centers) if width else []:
        costs[row["start"]] += row["cost"]
    return centers, costs


def kmeans_segments(
    df: DataFrame, key: str, features: list[str], k: int = 8, seeds: int = 10, seed: int = 42
) -> DataFrame:
    """K-means segment of each row on scaled features, the best of several starts, as 0/1 columns."""
    scaled = standardize(df.na.fill(0, features), features)
    ready = cut_lineage(scaled.select(key, F.array(*[F.col(c).cast("double") for c in features]).alias("point")))
    centers, costs = kmeans_starts(ready, key, k, seeds, seed)
    best = centers[min(range(seeds), key=lambda i: (costs[i], i))]
    segments = ready.select(key, _nearest([best], F.col("point"))[0]["cluster"].alias("cluster"))
    return segments.withColumns(
        {f"cluster_{i}": (F.col("cluster") == i).cast("int") for i in range(k)}
    )


def seed_bagging(train: DataFrame, scoring: DataFrame, make, seeds: list[int], key: str) -> DataFrame:
    """Mean prediction of each row over fits that differ in their seed only."""
    fitted = fit_side_by_side(train.sparkSession, lambda seed: make(seed).fit(train), seeds)
    wide, columns = predict_wide(fitted, scoring)
    total = F.lit(0.0)
    for column in columns:
        total = total + F.col(column)
    return wide.select(key, (total / len(columns)).alias("prediction"))


def save_pipeline(train: DataFrame, features: list[str], spec: Estimator, path: str) -> PipelineModel:
    """Fit assembler and model as one pipeline, save it and load it again."""
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    Pipeline(stages=[assembler, spec]).fit(train).write().overwrite().save(path)
    return PipelineModel.load(path)
