"""Predictions: metrics, ensembles, repair against a template, numbering and assignment."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.ratios import clip_low, key_hash
from sessionloom.operators.lookup import attach, last_wins
from sessionloom.operators.positions import number_in_order


def metrics(df: DataFrame, label: str, prediction: str, by: list[str]) -> DataFrame:
    """MSE, RMSE, MAE and R2 per group."""
    error = F.col(label) - F.col(prediction)
    return df.groupBy(*by).agg(
        F.avg(error * error).alias("mse"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (1 - F.try_divide(F.avg(error * error), F.var_pop(label))).alias("r2"),
    )


def leaderboard(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Models from the lowest error up, the first ``k`` if given."""
    ranked = scores.orderBy("rmse", "model")
    return ranked if k is None else ranked.limit(k)


def best_model(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.min_by("model", F.struct("rmse", "model")).alias("model"), F.min("rmse").alias("rmse")
    )


def ensemble_mean(predictions: DataFrame, key: str, prediction: str) -> DataFrame:
    """Plain mean over the models of a long prediction table."""
    return predictions.groupBy(key).agg(F.avg(prediction).alias(prediction))


def blend(predictions: DataFrame, weights: DataFrame, key: str, prediction: str) -> DataFrame:
    """Weighted mean with a weight per model (``model, weight``)."""
    weighted = predictions.join(weights, "model")
    total = F.sum(F.col("weight") * F.col(prediction)) / F.sum("weight")
    return weighted.groupBy(key).agg(total.alias(prediction))


def inverse_error_weights(scores: DataFrame) -> DataFrame:
    """Weights 1 / RMSE that sum to one."""
    total = scores.agg(F.sum(1 / F.col("rmse"))).scalar()
    return scores.select("model", (1 / F.col("rmse") / total).alias("weight"))


def error_products(predictions: DataFrame, names: list[str], label: str) -> list[list[float]]:
    """Mean products of the errors of each two models (a column each), from one aggregation."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    errors = predictions.select(*[(F.col(label) - F.col(n)).alias(f"e{i}") for i, n in enumerate(names)])
    row = errors.agg(F.array(*[F.avg(F.col(f"e{i}") * F.col(f"e{j}")) for i, j in pairs]).alias("m")).first()
    out = [[0.0] * len(names) for _ in names]
    for (i, j), value in zip(pairs, row["m"]):
        out[i][j] = out[j][i] = math.nan if value is None else value
    return out


def select_ensemble(products: list[list[float]], steps: int) -> tuple[list[int], list[float]]:
    """Greedy selection with replacement: (times each model was taken, RMSE after each step).

    Every step adds the model that makes the mean of all models taken so far best; of equally good
    ones the first. The error of any such mean follows from the products, so no row is read.
    """
    models = range(len(products))
    taken, errors = [0] * len(products), []
    for step in range(1, steps + 1):
        def error(k):
            count = [taken[i] + (i == k) for i in models]
            return sum(count[i] * count[j] * products[i][j] for i in models for j in models) / step**2

        best = min(models, key=lambda k: (round(error(k), 9), k))
        errors.append(math.sqrt(max(error(best), 0.0)))
        taken[best] += 1
    return taken, errors


def selection_weights(predictions: DataFrame, names: list[str], label: str, steps: int) -> DataFrame:
    """``model, taken, weight`` of the models of a wide prediction table; see ``select_ensemble``."""
    taken, _ = select_ensemble(error_products(predictions, names, label), steps)
    rows = [(name, count, count / steps) for name, count in zip(names, taken)]
    return predictions.sparkSession.createDataFrame(rows, "model string, taken int, weight double")


def row_mean(df: DataFrame, columns: list[str]):
    """Mean of several columns in a row, missing ones left out."""
    present = [F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in columns]
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    total, count = values[0], present[0]
    for value, one in zip(values[1:], present[1:]):
        total, count = total + value, count + one
    return F.try_divide(total, count)


def side_by_side(predictions: DataFrame, key: str, name: str, value: str, names: list[str]) -> DataFrame:
    """A column per model, matched by key instead of by position."""
    return predictions.groupBy(key).pivot(name, names).agg(F.first(value, ignorenulls=True))


def repair_predictions(
    template: DataFrame, predictions: DataFrame, key: str, prediction: str, order: str
) -> DataFrame:
    """Predictions for the keys of a template: the last one written, else the mean of all."""
    latest = last_wins(predictions, key, prediction, order)
    mean = predictions.agg(F.avg(prediction)).scalar()
    return attach(template, latest, key, {prediction: mean})


def unmatched(template: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """How many template keys have no prediction."""
    missing = template.join(predictions.select(key).distinct(), key, "left_anti")
    return missing.agg(F.count("*").alias("n_unmatched"))


def assign_at_random(
    template: DataFrame, predictions: DataFrame, key: str, id_: str, prediction: str, seed: int
) -> DataFrame:
    """Give each key one of the predictions, drawn with replacement by a seeded hash of the key."""
    numbered = number_in_order(predictions.select(id_, prediction), id_, "_draw")
    total = predictions.agg(F.count("*")).scalar()
    drawn = template.withColumn("_draw", F.pmod(key_hash(key, seed), total))
    return drawn.join(numbered.select("_draw", prediction), "_draw").drop("_draw")


def sample_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, drawn by a seeded hash of the key."""
    return df.orderBy(key_hash(key, seed), key).limit(n)


def clip_predictions(df: DataFrame, prediction: str, low: float = 0.0) -> DataFrame:
    return df.withColumn(prediction, clip_low(prediction, low))


def prediction_summary(df: DataFrame, prediction: str, by: list[str]) -> DataFrame:
    """Mean, population deviation, extremes and share of negative predictions."""
    value = F.col(prediction)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.count_if(value < 0).alias("n_negative"),
        (F.count_if(value < 0) / F.count("*")).alias("negative_share"),
    )


def importance_by_group(importances: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Sum of feature importance per feature group."""
    pairs = [F.struct(F.lit(f), F.lit(g)) for g, names in groups.items() for f in names]
    group = F.try_element_at(F.map_from_entries(F.array(*pairs)), F.col("feature"))
    return (
        importances.withColumn("feature_group", group)
        .where(F.col("feature_group").isNotNull())
        .groupBy("feature_group")
        .agg(F.sum("importance").alias("importance"))
    )
