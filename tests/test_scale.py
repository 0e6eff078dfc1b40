"""Steps that avoid a single hot task, against brute force on small skewed tables."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.functions.moments import micros
from sessionloom.operators import encode, models, positions, profile, textsim
from sessionloom.operators.sessions import weighted_side_mean
from sessionloom.sources.fixtures import number_sessions


def skewed_events(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    users = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 40, n))
    at = rng.integers(0, 60 * 86_400, n)
    rows = [(int(i), int(u), int(t), float(v)) for i, (u, t, v) in enumerate(zip(users, at, rng.integers(0, 9, n)))]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long, value double")
    moment = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s)")
    return rows, df.withColumn("ts", moment)


@pytest.mark.parametrize("gap", [3600, 86_400, 5 * 86_400])
def test_sessions_of_a_hot_user(spark, gap):
    rows, df = skewed_events(spark)
    expected = {}
    for user in {r[1] for r in rows}:
        number, last, mine = 0, None, sorted((r[2], r[0], r[3]) for r in rows if r[1] == user)
        for s, event, _ in mine:
            number += last is None or s - last > gap
            last = s
            expected[event] = (number, user)
    totals = {}
    for event, user, _, value in rows:
        key = (user, expected[event][0])
        totals[key] = totals.get(key, 0) + value
    got = number_sessions(df, "user_id", "ts", gap * 1_000_000, {"total": F.col("value")}).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["session_no"] == expected[r["event_id"]][0]
        assert r["total"] == totals[(r["user_id"], r["session_no"])]


def test_micros(spark):
    row = spark.sql("SELECT TIMESTAMP_NTZ '1969-12-31 23:59:59.999999' AS a, TIMESTAMP_NTZ '2024-02-29 12:30:15.000007' AS b")
    assert tuple(row.select(micros("a"), micros("b")).first()) == (-1, 1709209815000007)


@pytest.mark.parametrize("n", [1, 3, 4001])
@pytest.mark.parametrize("shape", ["spread", "tied"])
def test_exact_quantiles(spark, n, shape):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n) * 100
    if shape == "tied":
        x = np.where(rng.random(n) < 0.6, 7.0, np.round(x))
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    for accuracy, keep in ((10_000, 1_000_000), (50, 20)):
        got = profile.exact_quantiles(df, ["x"], probs, accuracy=accuracy, keep=keep)["x"]
        assert np.allclose(got, np.quantile(x, probs), rtol=0, atol=1e-9)


def test_positions_over_many_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v")).repartition(16)
    got = positions.number_in_order(df, "v").collect()
    for place, row in enumerate(sorted(got, key=lambda r: r["v"])):
        assert row["position"] == place


def test_domain_codes_are_sorted(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "B", "ä", "a", None, "a"]], "v string")
    got = {r["v"]: r["code"] for r in encode.domain_codes(df, "v").collect()}
    assert got == {v: i for i, v in enumerate(sorted(["b", "B", "ä", "a"]))}


def test_weighted_side_mean(spark):
    _, df = skewed_events(spark, 500)
    events = df.select((F.col("user_id") % 5).alias("user_session"), F.col("value").cast("int").alias("p"))
    side = spark.createDataFrame([(i, float(i * i)) for i in range(5)], "p int, price double")
    got = {r["user_session"]: r["m"] for r in weighted_side_mean(events, "p", side, "price", F.lit(-1.0), "m").collect()}
    rows = events.collect()
    for key in {r["user_session"] for r in rows}:
        mine = [float(r["p"] ** 2) if r["p"] < 5 else -1.0 for r in rows if r["user_session"] == key]
        assert math.isclose(got[key], sum(mine) / len(mine))


def random_texts(n, seed, hot):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    result = set()
    while len(result) < n:
        words = list(rng.choice(vocabulary, rng.integers(1, 7)))
        result.add(" ".join((["lise"] if rng.random() < hot else []) + words))
    return sorted(result)


def vectors(spark, texts):
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    weights = textsim.tfidf(docs, "t", "t").cache()
    found = {}
    for r in weights.collect():
        found.setdefault(r["id"], {})[r["term"]] = r["w"]
    return weights, found


@pytest.mark.parametrize("min_sim", [0.05, 0.3, 0.9])
def test_similar_pairs_find_all(spark, min_sim, monkeypatch):
    monkeypatch.setattr(textsim, "HOT_ROWS", 10)  # hot terms fall into several blocks
    texts = random_texts(120, 3, hot=0.7)
    weights, found = vectors(spark, texts)
    expected = {}
    for a, b in itertools.combinations(texts, 2):
        sim = sum(w * found[b].get(t, 0.0) for t, w in found[a].items())
        if sim >= min_sim:
            expected[(a, b)] = sim
    got = {(r["a"], r["b"]): r["sim"] for r in textsim.cosine_pairs(weights, min_sim).collect()}
    assert got.keys() == expected.keys()
    assert all(math.isclose(got[k], expected[k], abs_tol=1e-9) for k in got)


def average_linkage(sim, t):
    groups = [[i] for i in range(len(sim))]
    while len(groups) > 1:
        best = max(
            (np.mean([sim[x][y] for x in a for y in b]), i, j)
            for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2)
        )
        if 1 - best[0] >= t:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("threshold", [0.8])
def test_clusters_equal_average_linkage(spark, threshold):
    rng = np.random.default_rng(11)
    terms = [f"t{i}" for i in range(12)]
    rows, dense = [], []
    for i in range(10):
        w = rng.random(12) * (rng.random(12) < 0.4)
        w[rng.integers(12)] += 0.5
        w /= np.linalg.norm(w)
        if i == 9:
            w = dense[0]  # a copy
        dense.append(w)
        rows += [(f"d{i:02d}", t, float(v)) for t, v in zip(terms, w) if v > 0]
    weights = spark.createDataFrame(rows, "id string, term string, w double")
    sim = np.array(dense) @ np.array(dense).T
    expected = {frozenset(f"d{i:02d}" for i in g) for g in average_linkage(sim, threshold)}
    got = {}
    for r in textsim.linkage_clusters(weights, threshold).collect():
        got.setdefault(r["cluster"], set()).add(r["id"])
    assert {frozenset(g) for g in got.values()} == expected


def test_split_keeps_sessions_together(spark):
    _, df = skewed_events(spark, 500)
    split = models.hash_split(df, "user_id", seed=7)
    sides = split.groupBy("user_id").agg(F.countDistinct("is_validation").alias("n"))
    assert sides.where("n > 1").count() == 0
    again = models.hash_split(df.repartition(7), "user_id", seed=7)
    assert split.exceptAll(again).count() == 0


def test_seed_draws_are_repeatable(spark):
    spec = models.forest()
    grid = {"maxDepth": [2, 3, 4], "numTrees": [3, 5]}
    assert models.draw_grid(spec, grid, 4, 1) == models.draw_grid(spec, grid, 4, 1)
    assert len({tuple(sorted((p.name, v) for p, v in m.items())) for m in models.draw_grid(spec, grid, 6, 1)}) == 6
