"""Extremely randomised trees against a plain numpy version with the same draws."""

import numpy as np
import pytest

from sessionloom.operators.extra_trees import draw, fit_extra_trees


def plain_tree(x, y, tree, depth, seed, least):
    """{node: (feature, threshold)} and {node: mean} of one tree, node by node."""
    splits, means, todo = {}, {1: y.mean()}, [(1, np.arange(len(y)))]
    while todo:
        node, mine = todo.pop()
        if node >= 2**depth:
            continue
        best, gain = None, y[mine].sum() ** 2 / len(mine) * (1 + 1e-12)
        for f in range(x.shape[1]):
            own = mine[~np.isnan(x[mine, f])]
            if not len(own) or x[own, f].min() == x[own, f].max():
                continue
            low, high = x[own, f].min(), x[own, f].max()
            cut = low + draw(seed, tree, node, f) * (high - low)
            left, right = own[x[own, f] <= cut], own[x[own, f] > cut]
            rest = mine[np.isnan(x[mine, f])]
            if len(left) < least or len(right) < least:
                continue
            between = sum(y[p].sum() ** 2 / len(p) for p in (left, right, rest) if len(p))
            if between > gain:
                best, gain = (f, cut, left, right), between
        if best:
            f, cut, left, right = best
            splits[node] = (f, cut)
            for side, part in ((2 * node, left), (2 * node + 1, right)):
                means[side] = y[part].mean()
                todo.append((side, part))
    return splits, means


@pytest.mark.parametrize("least", [1, 8])
def test_trees_equal_a_plain_version(spark, least):
    random = np.random.default_rng(least)
    x = random.integers(0, 9, (250, 3)).astype(float)
    x[random.random(250) < 0.1, 1] = np.nan
    y = np.floor(x[:, 0] * 3 + np.nan_to_num(x[:, 1]) ** 2 + random.integers(0, 5, 250))
    rows = [(*(None if np.isnan(v) else float(v) for v in a), float(b), 7) for a, b in zip(x, y)]
    rows += [(1.0, 2.0, 3.0, None, 7)]  # without a label
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, node int").repartition(4)
    model = fit_extra_trees(df, ["a", "b", "c"], "y", trees=3, depth=4, seed=5, least=least)
    total = np.zeros(len(y))
    for t, tree in enumerate(model.trees):
        splits, means = plain_tree(x, y, t, 4, 5, least)
        assert {i + 1: (f, tree["threshold"][i]) for i, f in enumerate(tree["feature"]) if f is not None} == splits
        got = {i + 1: v for i, v in enumerate(tree["value"]) if v is not None}
        assert got.keys() == means.keys() and all(abs(got[n] - means[n]) < 1e-9 for n in means)
        for i in range(len(y)):
            node = 1
            while node in splits and not np.isnan(x[i, splits[node][0]]):
                node = 2 * node + int(x[i, splits[node][0]] > splits[node][1])
            total[i] += means[node] / 3
    want = sorted(zip(y, total))
    found = df.where("y IS NOT NULL").withColumn("p", model.prediction()).select("y", "p").collect()
    assert np.allclose(np.array(sorted((r.y, r.p) for r in found)), np.array(want))


def test_trees_of_odd_tables(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 5 + [(float("nan"), 4.0)] * 5, "a double, y double")
    model = fit_extra_trees(df, ["a"], "y", trees=2, depth=3)
    assert {r.p for r in df.select(model.prediction().alias("p")).collect()} == {3.0}  # nothing to split
    none = fit_extra_trees(df.limit(0), ["a"], "y", trees=2, depth=3)
    assert {r.p for r in df.select(none.prediction().alias("p")).collect()} == {None}
