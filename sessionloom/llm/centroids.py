"""Centroid clustering of integer vectors with built-in Spark functions only."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.storage import store

DIMENSIONS = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
SEED = 2
LARGEST = 1 << 26  # of a component: squared distances of 64 of them stay below 2 ** 63


@dataclass
class Clustering:
    """``assigned`` has one row per kept vector: vec_id, cluster, distance; ``centroids`` are the
    final ones, at most as many as asked for."""

    assigned: DataFrame
    centroids: list[list[int]]


def whole_vectors(vectors: DataFrame, key: str, vector: str, size: int | None, scale: int) -> DataFrame:
    """``vec_id, x``: vectors with exactly ``size`` components (None: any number), none null, NaN or
    infinite, as integers floor(scale * component)."""
    v = F.col(vector).cast("array<double>")
    usable = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    if size is not None:
        usable = (F.size(v) == size) & usable
    x = F.transform(v, lambda c: F.floor(c * F.lit(float(scale))))
    kept = vectors.where(F.col(vector).isNotNull() & F.coalesce(usable, F.lit(False)))
    return kept.select(F.col(key).alias("vec_id"), x.alias("x"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors with the k smallest SHA-256 of ``seed:vec_id``; equal ids in the order of their
    vectors, vectors without an id last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(digest.alias("digest"), "x").orderBy(F.asc_nulls_last("digest"), "x").limit(k)
    return [list(row["x"]) for row in first.collect()]


def literal(centroids: list[list[int]]) -> Column:
    """The centroids as one constant array of arrays."""
    rows = ", ".join("array(" + ", ".join(f"{c}L" for c in row) + ")" for row in centroids)
    return F.expr(f"array({rows})")


def nearest(centroids: list[list[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid; equal distances go to the smaller number."""
    return F.array_min(
        F.transform(
            literal(centroids),
            lambda centre, number: F.struct(
                F.aggregate(
                    F.zip_with(F.col("x"), centre, lambda a, b: (a - b) * (a - b)),
                    F.lit(0).cast("long"),
                    lambda total, part: total + part,
                ).alias("distance"),
                number.alias("cluster"),
            ),
        )
    )


def moved(kept: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Every centroid that has vectors replaced by floor(sum / count) of each component.

    Sums are columns of one aggregation with partial sums, so a cluster with most of the vectors
    costs one row per task; what returns is one row per centroid.
    """
    size = len(centroids[0])
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(size)]
    placed = kept.select("x", nearest(centroids)["cluster"].alias("cluster"))
    found = placed.groupBy("cluster").agg(F.count("*").alias("n"), *sums)
    centre = [F.expr(f"(s{i} - pmod(s{i}, n)) div n").alias(f"c{i}") for i in range(size)]
    out = list(centroids)
    for row in found.select("cluster", *centre).collect():
        out[row["cluster"]] = list(row)[1:]
    return out


def cluster_vectors(
    vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED,
    size: int = DIMENSIONS, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding",
) -> Clustering:
    """K-means on integers, exact in every step and the same under any partitioning.

    Vectors that are null, of another size or with null, NaN or infinite components take no part.
    Each round is one pass: distances to literal centroids, the smallest (distance, number), and
    sums per centroid. Rows that repeat count as often as they stand there, and each has its row in
    the result; ids may be null or repeat. With fewer than k vectors there are fewer centroids, with
    none the result is empty. Components of ``LARGEST`` or more after scaling raise ValueError.
    """
    kept = store(whole_vectors(vectors, key, vector, size, scale), "vectors")
    most = kept.agg(F.max(F.array_max(F.transform("x", F.abs))).alias("m")).first()["m"]
    if most is not None and most >= LARGEST:
        raise ValueError(f"components up to {most} are too large for exact distances")
    centroids = first_centroids(kept, k, seed)
    if not centroids:
        none = kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return Clustering(none, [])
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    best = nearest(centroids)
    assigned = kept.select("vec_id", best.alias("best")).select(
        "vec_id", F.col("best.cluster").alias("cluster"), F.col("best.distance").alias("distance")
    )
    return Clustering(store(assigned, "assigned"), centroids)


def clusters_with_inertia(clustering: Clustering) -> DataFrame:
    """The assigned rows with the distances summed over their cluster and over all, and the SHA-256
    of the final centroid's components joined by commas."""
    assigned = clustering.assigned
    own = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in clustering.centroids]
    digest = F.array(*[F.lit(d) for d in digests]) if digests else F.array().cast("array<string>")
    facts = own.withColumns(
        {
            "inertia": own.agg(F.sum("cluster_inertia")).scalar(),
            "centroid_sha256": F.try_element_at(digest, F.col("cluster") + 1),
        }
    )
    # One row per centroid, so the broadcast is bounded by k.
    return assigned.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
