"""Extremely randomised trees for regression, grown level by level from sums that add up.

Every tree sees all rows. A node draws one threshold for each feature, uniformly between the smallest
and largest value the feature has in the node, and takes the feature whose two sides differ most. All
trees grow together: a level costs two scans of the rows, one for the ranges and one for the sums of
both sides, each reduced to one row per open node before the shuffle. Rows carry no state; their node
is found again from the root, so a lost executor costs only its tasks.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TREE = "struct<feature: array<int>, threshold: array<double>, value: array<double>>"


def draw(seed: int, tree: int, node: int, feature: int) -> float:
    """The place of a threshold in its range, from 0 to 1; the same wherever and whenever it is drawn."""
    return random.Random(f"{seed}:{tree}:{node}:{feature}").random()


def vector(features: list[str]) -> Column:
    """The features as an array of doubles; values that are not finite count as missing."""
    values = [F.col(f"`{c}`").cast("double") for c in features]
    return F.array(*[F.when(F.abs(v) < float("inf"), v) for v in values])


def reached(trees: Column, x: Column, depth: int) -> Column:
    """For each tree the number of the node that a row ends in; a row stops where its value is missing."""

    def end(tree: Column) -> Column:
        def step(node: Column, _: Column) -> Column:
            value = F.get(x, F.get(tree["feature"], node - 1))
            right = (value > F.get(tree["threshold"], node - 1)).cast("int")
            return F.coalesce((node * 2 + right).cast("int"), node)

        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), step) if depth else F.lit(1)

    return F.transform(trees, end)


@dataclass
class ExtraTrees:
    """Trees as arrays by node number: the root is 1, the sides of node n are 2n and 2n + 1."""

    features: list[str]
    depth: int
    trees: list[dict[str, list]]

    def column(self) -> Column:
        """The trees as one constant; their size is bounded by the number of trees and the depth."""
        return F.from_json(F.lit(json.dumps(self.trees)), f"array<{TREE}>")

    def prediction(self) -> Column:
        """Mean over the trees of the mean label of the node reached; null if there was nothing to learn."""
        trees = self.column()
        ends = reached(trees, vector(self.features), self.depth)
        values = F.zip_with(trees, ends, lambda tree, node: F.get(tree["value"], node - 1))
        return F.aggregate(values, F.lit(0.0), lambda total, v: total + v) / len(self.trees)


def best_side(row, count: int, least: int) -> int | None:
    """The feature whose sides have the largest sum of squares between them; the first of equals."""
    n, s = row["n"], row["s"]
    best, gain = None, s * s / n * (1 + 1e-12)
    for f in range(count):
        left, total = row[f"n{f}"], row[f"s{f}"]
        seen, whole = row[f"m{f}"], row[f"t{f}"]
        if left < least or seen - left < least:
            continue
        # rows without a value stay behind and count with their own mean
        rest = (s - whole) ** 2 / (n - seen) if n > seen else 0.0
        between = total**2 / left + (whole - total) ** 2 / (seen - left) + rest
        if between > gain:
            best, gain = f, between
    return best


def fit_extra_trees(
    df: DataFrame,
    features: list[str],
    label: str,
    trees: int = 20,
    depth: int = 6,
    seed: int = 42,
    least: int = 1,
) -> ExtraTrees:
    """Grow ``trees`` trees of at most ``depth`` levels with ``least`` rows or more on each side.

    Rows without a label teach nothing; repeated rows count each. ``df`` is scanned twice a level, so
    write it first if it is costly to compute.
    """
    count = len(features)
    rows = df.where(F.col(label).isNotNull()).select(
        vector(features).alias("x"), F.col(label).cast("double").alias("y")
    )
    nodes = 2 ** (depth + 1) - 1
    grown = [{"feature": [None] * nodes, "threshold": [None] * nodes, "value": [None] * nodes} for _ in range(trees)]
    model = ExtraTrees(features, depth, grown)
    root = rows.agg(F.avg("y").alias("mean")).first()["mean"]
    for tree in grown:
        tree["value"][0] = root
    open_ = {(t, 1) for t in range(trees)} if root is not None and count else set()
    for level in range(depth):
        if not open_:
            break
        first, width = 2**level, 2**level
        ends = reached(model.column(), F.col("x"), level)
        placed = rows.select("x", "y", F.posexplode(ends).alias("tree", "node")).where(F.col("node") >= first)
        ranges = placed.groupBy("tree", "node").agg(
            *[f(F.get("x", F.lit(i))).alias(f"{name}{i}") for i in range(count) for name, f in (("low", F.min), ("high", F.max))]
        )
        cuts: dict[tuple[int, int], list] = {}
        for row in ranges.collect():  # at most trees times nodes of a level
            at = row["tree"], row["node"]
            if at in open_:
                cuts[at] = [
                    low + draw(seed, *at, i) * (high - low) if low is not None and low < high else None
                    for i, (low, high) in enumerate((row[f"low{i}"], row[f"high{i}"]) for i in range(count))
                ]
        table = [[cuts.get((t, first + k)) for k in range(width)] for t in range(trees)]
        drawn = F.from_json(F.lit(json.dumps(table)), "array<array<array<double>>>")
        cut = F.get(F.get(drawn, F.col("tree")), F.col("node") - first)
        sided = placed.withColumn("cut", cut).where("cut IS NOT NULL")
        sums = [F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")]
        for i in range(count):
            value = F.get("x", F.lit(i))
            left = value <= F.get("cut", F.lit(i))
            sums += [
                F.count_if(left).alias(f"n{i}"), F.coalesce(F.sum(F.when(left, F.col("y"))), F.lit(0.0)).alias(f"s{i}"),
                F.count(value).alias(f"m{i}"), F.coalesce(F.sum(F.when(value.isNotNull(), F.col("y"))), F.lit(0.0)).alias(f"t{i}"),
            ]
        after = set()
        for row in sided.groupBy("tree", "node").agg(*sums).collect():  # as many again
            t, node = row["tree"], row["node"]
            f = best_side(row, count, least)
            if f is None:
                continue
            tree = grown[t]
            tree["feature"][node - 1], tree["threshold"][node - 1] = f, cuts[t, node][f]
            left, right = row[f"n{f}"], row[f"m{f}"] - row[f"n{f}"]
            tree["value"][2 * node - 1] = row[f"s{f}"] / left
            tree["value"][2 * node] = (row[f"t{f}"] - row[f"s{f}"]) / right
            after |= {(t, 2 * node), (t, 2 * node + 1)}
        open_ = after
    return model
