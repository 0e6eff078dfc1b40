"""Text queries over all terms."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from sessionloom.operators import history, models, textsim
from sessionloom.plans.catalog import CHECKS, QUERIES
from tests.checker import compare, connect

FOLDER = "/root/testdata/sf0.001"


def test_rare_terms_have_weights(spark):
    rows = [(k, " ".join(["often", *(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600))])) for k in range(2)]
    rows += [(9, " ".join(f"rare{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)))]
    found = textsim.tfidf(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()
    assert len({r.term for r in found}) == 1201 and sum(r.id == 9 for r in found) == 600


def test_document_queries_over_all_terms(spark):
    for name in ("tfidf_documents_all", "cosine_pairs_documents_all", "tfidf_documents"):
        assert compare(spark, connect(FOLDER), name, QUERIES[name], CHECKS[name], FOLDER) == []


def test_ordered_means_see_earlier_rows_only(spark):
    rows = [(k, None if k % 7 == 0 else "hot" if k % 3 else f"v{k % 5}", float(k % 11) if k % 4 else None, 1) for k in range(300)]
    rows += rows[:20]  # repeated rows
    df = spark.createDataFrame(rows, "id long, value string, y double, _row int").repartition(5)
    place = {k: int(hashlib.md5(f"42:{k}".encode()).hexdigest()[:15], 16) for k in range(300)}
    labels = [r[2] for r in rows if r[2] is not None]
    for slot_rows in (1_000_000, 10):  # one slot, many slots
        got = history.ordered_target_mean(df, "id", "value", "y", "m", slot_rows=slot_rows)
        assert got.columns == ["id", "value", "y", "_row", "m"] and got.count() == len(rows)
        for row in got.collect():
            seen = [y for k, v, y, _ in rows if y is not None and v == row.value
                    and (row.y is None or place[k] < place[row.id])]
            assert abs(row.m - (sum(seen) + sum(labels) / len(labels)) / (len(seen) + 1)) < 1e-9
    none = history.ordered_target_mean(df.withColumn("y", F.lit(None).cast("double")), "id", "value", "y", "m")
    assert none.where("m is not null").count() == 0 and none.count() == len(rows)
    assert history.ordered_target_mean(df.limit(0), "id", "value", "y", "m").count() == 0


def test_kmeans_keeps_the_best_of_all_starts(spark):
    random = np.random.default_rng(4)
    data = np.concatenate([random.normal(c, 0.2, (40, 2)) for c in ((0, 0), (5, 0), (0, 5), (5, 5))])
    points = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, point array<double>")
    centers, costs = models.kmeans_starts(points, "id", 4, 6)
    for own, cost in zip(centers, costs):
        gaps = ((data[:, None] - np.array(own)) ** 2).sum(axis=2)
        assert abs(gaps.min(axis=1).sum() - cost) < 1e-6
        for c in range(4):  # a fixed point of the rounds
            mine = data[gaps.argmin(axis=1) == c]
            assert not len(mine) or np.abs(mine.mean(axis=0) - own[c]).max() < 1e-3
    assert min(costs) < 20  # four groups found
    wide = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(data)], "id long, a double, b double")
    segments = models.kmeans_segments(wide, "id", ["a", "b"], k=4, seeds=6).toPandas()
    assert (segments[[f"cluster_{i}" for i in range(4)]].sum(axis=1) == 1).all()
    assert models.kmeans_segments(wide.limit(0), "id", ["a", "b"], k=4, seeds=2).count() == 0
    assert models.kmeans_segments(wide.limit(2), "id", ["a", "b"], k=4, seeds=2).count() == 2
