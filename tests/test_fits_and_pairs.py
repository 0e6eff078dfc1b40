"""Least squares, ensembles, importance, vectors and clusters against plain numpy."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.operators import leastsq, models, score, textsim


def linear_rows(seed=1, n=200):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 100, 0.01] + [0, 1e6, 5]
    y = x @ [2.0, -0.03, 50.0] + 7 + rng.normal(size=n)
    return x, y


def frame(spark, x, y):
    rows = [(i, *map(float, v), 4.0, float(v[0]), float(t), i % 5) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "key long, a double, b double, c double, flat double, again double, y double, fold int")


def test_least_squares_equal_numpy(spark):
    x, y = linear_rows()
    df = frame(spark, x, y)
    fit = leastsq.fit_linear(df, ["a", "b", "c", "flat", "again"], "y")
    design = np.column_stack([np.ones(len(x)), x])
    want = np.linalg.lstsq(design, y, rcond=None)[0]
    assert math.isclose(fit.coefficients[0] + fit.coefficients[4], want[1], rel_tol=1e-8)
    assert np.allclose(fit.coefficients[1:3], want[2:], rtol=1e-8) and fit.coefficients[3] == 0
    got = [r["p"] for r in df.orderBy("key").select(fit.prediction().alias("p")).collect()]
    assert np.allclose(got, design @ want, atol=1e-6)


def test_folds_from_one_scan_equal_fits_on_the_other_folds(spark):
    x, y = linear_rows(2)
    got = {r["fold"]: r["rmse"] for r in leastsq.linear_fold_scores(frame(spark, x, y), ["a", "b", "c"], "y", "fold").collect()}
    design, fold = np.column_stack([np.ones(len(x)), x]), np.arange(len(x)) % 5
    for f in range(5):
        weights = np.linalg.lstsq(design[fold != f], y[fold != f], rcond=None)[0]
        assert math.isclose(got[f], np.sqrt(np.mean((y[fold == f] - design[fold == f] @ weights) ** 2)), rel_tol=1e-8)


def test_least_squares_of_few_or_incomplete_rows(spark):
    none = spark.createDataFrame([], "a double, y double, fold int")
    fit = leastsq.fit_linear(none, ["a"], "y")
    assert fit.coefficients.tolist() == [0.0] and fit.intercept == 0.0
    assert leastsq.linear_fold_scores(none, ["a"], "y", "fold").count() == 0
    gaps = spark.createDataFrame([(None, 1.0, 0), (2.0, 5.0, 0), (9.0, None, 1)], "a double, y double, fold int")
    fit = leastsq.fit_linear(gaps, ["a"], "y")
    assert math.isclose(fit.coefficients[0], 2.0) and math.isclose(fit.intercept, 1.0)


def test_selection_takes_the_best_mean_at_every_step(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(size=300)
    p = [y + rng.normal(size=300) * s + b for s, b in ((0.5, 0.3), (0.6, -0.3), (2.0, 0.0), (0.7, 0.1))]
    taken, want = [], []
    for _ in range(12):
        errors = [np.sqrt(np.mean((y - np.mean([p[k] for k in [*taken, i]], axis=0)) ** 2)) for i in range(4)]
        taken.append(int(np.argmin(errors)))
        want.append(min(errors))
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(float(t), *map(float, r)) for t, r in zip(y, zip(*p))], "y double, a double, b double, c double, d double")
    counts, errors = score.select_ensemble(score.error_products(df, names, "y"), 12)
    assert counts == [taken.count(i) for i in range(4)] and np.allclose(errors, want)
    weights = {r["model"]: r["weight"] for r in score.selection_weights(df, names, "y", 12).collect()}
    assert math.isclose(sum(weights.values()), 1.0)


def test_out_of_fold_predictions_have_not_seen_their_row(spark):
    x, y = linear_rows(3, 60)
    table = models.training_table(frame(spark, x, y), "key", ["a", "b"], "y", folds=3)
    got = models.out_of_fold(table, {"linear": models.linear(solver="normal")}, 3, ["key", "label", "fold"]).toPandas()
    assert sorted(got["key"]) == list(range(60))
    design = np.column_stack([np.ones(60), x[:, :2]])
    fold = got.sort_values("key")["fold"].to_numpy()
    for f in range(3):
        weights = np.linalg.lstsq(design[fold != f], y[fold != f], rcond=None)[0]
        assert np.allclose(got[got["fold"] == f].sort_values("key")["linear"], design[fold == f] @ weights, atol=1e-3)


def test_permuted_values_keep_their_set_and_leave_their_row(spark):
    x, y = linear_rows(5, 40)
    df = frame(spark, x, y)
    seen = []

    def predict(rows):
        seen.append(rows.select("_i", "_label", "a", "b").toPandas())
        return rows.withColumn("prediction", F.col("a") * 2)

    got = {r["feature"]: r for r in models.permutation_importance(df, "key", ["a", "b"], "y", predict).collect()}
    rows = seen[0]
    plain, moved = rows[rows["_i"] == -1].sort_values("_label"), rows[rows["_i"] == 0].sort_values("_label")
    assert sorted(plain["a"]) == sorted(moved["a"]) and (plain["a"].to_numpy() != moved["a"].to_numpy()).all()
    assert (plain["b"].to_numpy() == moved["b"].to_numpy()).all()
    assert got["b"]["rise"] == 0 and got["a"]["rise"] != 0
    one = models.permutation_importance(
        df.limit(1), "key", ["a"], "y", lambda rows: rows.withColumn("prediction", F.col("a"))
    ).collect()
    assert [(r["feature"], r["rise"]) for r in one] == [("a", 0.0)]


def test_counts_inside_the_row(spark):
    texts = ["b a bb aa bb", "", None, "x", "Aa aa AA çç zz"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r["id"]: {e["term"]: e["tf"] for e in r["terms"]} for r in textsim.term_counts(df, "id", "t").collect()}
    assert got == {0: {"bb": 2, "aa": 1}, 1: {}, 2: {}, 3: {}, 4: {"aa": 3, "çç": 1, "zz": 1}}


def test_equal_texts_count_once(spark):
    df = spark.createDataFrame([(3, "aa bb"), (1, "aa bb"), (2, "aa"), (4, ""), (5, None)], "id long, t string")
    once = {r["id"] for r in textsim.tfidf_vectors(df, "id", "t", once=True).collect()}
    assert once == {1, 2} and textsim.tfidf_vectors(df, "id", "t").count() == 3


def linkage(sim, least):
    """Average linkage on a whole similarity matrix."""
    sums, size, groups = sim.copy(), np.ones(len(sim)), {i: {i} for i in range(len(sim))}
    alive = np.ones(len(sim), bool)
    while True:
        mean = np.where(alive[:, None] & alive[None, :], sums / np.outer(size, size), -1)
        np.fill_diagonal(mean, -1)
        i, j = divmod(int(mean.argmax()), len(sim))
        if mean[i, j] <= least:
            return {frozenset(groups[k]) for k in np.flatnonzero(alive)}
        sums[i] += sums[j]
        sums[:, i] += sums[:, j]
        size[i] += size[j]
        groups[i] |= groups[j]
        alive[j] = False


@pytest.mark.parametrize("cut", [0.6])
def test_kept_pairs_give_average_linkage_of_300_texts(spark, cut):
    rng = np.random.default_rng(9)
    dense = rng.random((300, 25)) * (rng.random((300, 25)) < 0.25)
    dense[np.arange(300), rng.integers(0, 25, 300)] += 0.5
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    rows = [(i, f"t{j}", float(dense[i, j])) for i, j in itertools.product(range(300), range(25)) if dense[i, j]]
    weights = spark.createDataFrame(rows, "id long, term string, w double")
    got = {}
    for r in textsim.linkage_clusters(weights, cut).collect():
        got.setdefault(r["cluster"], set()).add(r["id"])
    assert {frozenset(g) for g in got.values()} == linkage(dense @ dense.T, 1 - cut)
    assert all(name == min(g) for name, g in got.items())


def test_a_chain_of_many_rounds_ends(spark):
    """Each text is closest to the one before, so one pair merges in a round."""
    angle = np.cumsum(0.1 * 1.2 ** np.arange(14))
    angle = angle / angle[-1] * 1.5
    rows = [(i, t, float(v)) for i, a in enumerate(angle) for t, v in (("x", math.cos(a)), ("y", math.sin(a))) if v > 0]
    weights = spark.createDataFrame(rows, "id long, term string, w double")
    dense = np.array([[math.cos(a), math.sin(a)] for a in angle])
    got = {}
    for r in textsim.linkage_clusters(weights, 0.5).collect():
        got.setdefault(r["cluster"], set()).add(r["id"])
    assert {frozenset(g) for g in got.values()} == linkage(dense @ dense.T, 0.5)
