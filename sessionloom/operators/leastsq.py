"""Least squares from means and co-moments that are summed once, fold by fold, in one scan."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class LinearFit:
    features: list[str]
    coefficients: np.ndarray
    intercept: float

    def prediction(self) -> Column:
        """The fitted value as a column; a missing feature counts as 0."""
        total = F.lit(float(self.intercept))
        for name, weight in zip(self.features, self.coefficients):
            total = total + F.lit(float(weight)) * F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        return total


@dataclass
class Moments:
    """Row count, means and summed centred products of the features and, last, the label."""

    features: list[str]
    n: int
    mean: np.ndarray
    products: np.ndarray

    def __add__(self, other: "Moments") -> "Moments":
        """Both sets of rows together, as partial aggregates are merged."""
        n = self.n + other.n
        if not n:
            return self
        shift = other.mean - self.mean
        products = self.products + other.products + np.outer(shift, shift) * (self.n * other.n / n)
        return Moments(self.features, n, self.mean + shift * (other.n / n), products)

    def fit(self) -> LinearFit:
        """Normal equations of the centred columns scaled to unit length, solved with least norm: a
        constant column gets weight 0, equal columns share one."""
        xx, xy = self.products[:-1, :-1], self.products[:-1, -1]
        length = np.sqrt(np.diag(xx))
        length = np.where(length > 0, length, 1.0)
        scaled = np.linalg.pinv(xx / np.outer(length, length), rcond=1e-12, hermitian=True) @ (xy / length)
        weights = scaled / length
        return LinearFit(self.features, weights, float(self.mean[-1] - weights @ self.mean[:-1]))

    def mean_squared_error(self, fit: LinearFit) -> float:
        """Of any linear fit over these rows, without reading them again."""
        if not self.n:
            return math.nan
        turn = np.append(-fit.coefficients, 1.0)
        off = self.mean @ turn - fit.intercept
        return max(float(turn @ self.products @ turn) / self.n, 0.0) + float(off * off)


def moments(df: DataFrame, features: list[str], label: str, by: str | None = None) -> dict[object, Moments]:
    """Moments of the labelled rows for each value of ``by`` (folds: few values), in one aggregation.

    ``covar_pop`` keeps centred sums and merges partial ones, so large means cost no digits. What
    comes to the driver is one row per fold. A missing feature counts as 0.
    """
    columns = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]
    columns.append(F.col(label).cast("double"))
    size = len(columns)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    names = [f"_c{i}" for i in range(size)]
    rows = df.where(F.col(label).isNotNull()).select(
        (F.lit(0) if by is None else F.col(by)).alias("_by"), *[c.alias(n) for c, n in zip(columns, names)]
    )
    found = rows.groupBy("_by").agg(
        F.count("*").alias("n"),
        F.array(*[F.avg(n) for n in names]).alias("mean"),
        F.array(*[F.covar_pop(names[i], names[j]) for i, j in pairs]).alias("products"),
    )
    out = {}
    for row in found.collect():
        products = np.zeros((size, size))
        for (i, j), value in zip(pairs, row["products"]):
            products[i, j] = products[j, i] = value * row["n"]
        out[row["_by"]] = Moments(features, row["n"], np.array(row["mean"], float), products)
    return out


def fit_linear(df: DataFrame, features: list[str], label: str) -> LinearFit:
    """Ordinary least squares with an intercept; without labelled rows every weight is 0."""
    found = moments(df, features, label)
    if not found:
        return LinearFit(features, np.zeros(len(features)), 0.0)
    return found[0].fit()


def fold_fits(parts: dict[object, Moments]) -> dict[object, LinearFit]:
    """For each fold the fit on all others."""
    return {
        fold: reduce(lambda a, b: a + b, [m for other, m in parts.items() if other != fold]).fit()
        for fold in parts
        if len(parts) > 1
    }


def linear_fold_scores(df: DataFrame, features: list[str], label: str, fold: str) -> DataFrame:
    """``fold, rmse``: the error on each fold of the fit on the others, all from one scan."""
    parts = moments(df, features, label, fold)
    fits = fold_fits(parts)
    rows = [(int(f), math.sqrt(parts[f].mean_squared_error(fits[f]))) for f in sorted(fits)]
    return df.sparkSession.createDataFrame(rows, "fold int, rmse double")
