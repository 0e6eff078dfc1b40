"""Whitening, shards and centroids against brute force, with odd rows."""

import hashlib
import os
import zlib

import numpy as np
import pandas as pd
import pytest

from sessionloom.llm import centroids, queries, shards, spectra, whitening
from tests.checker import compare, connect

FOLDER = os.environ.get("CHECK_DIR", "/root/testdata/sf0.001")
VECTORS = "vec_id long, embedding array<float>, x int, cluster string, n long, best int"
DOCS = "doc_id long, text string, lang string, record int, h1 long, bucket int, slot int, shard int, copy int"


def vector_rows(seed=1, many=300, size=64, rank=None):
    rng = np.random.default_rng(seed)
    found = rng.normal(size=(many, rank or size)) / 8
    return found @ rng.normal(size=(rank, size)) if rank else found


def odd_vectors(spark, values):
    rows = [(i, [float(c) for c in v], 1, "a", 2, 3) for i, v in enumerate(values)]
    rows += rows[:20] + [(None, rows[3][1], None, None, None, None)]
    bad = [None, [], [1.0], [None] * len(values[0]), [float("nan")] * len(values[0]), [float("inf")] * len(values[0])]
    rows += [(1000 + i, b, 1, "a", 2, 3) for i, b in enumerate(bad)]
    return spark.createDataFrame(rows, VECTORS).repartition(5)


def kept_vectors(df):
    rows = []
    for r in df.collect():
        v = r["embedding"]
        if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v):
            rows.append((r["vec_id"], np.floor(256 * np.array(v, float)).astype(int)))
    return rows


def direct_spectrum(x):
    off = x - x.mean(0)
    return np.linalg.eigvalsh(off.T @ off)


@pytest.mark.parametrize("streams", [1, 3, 16])
@pytest.mark.parametrize("rows, size, rank", [(200, 12, None), (60, 20, 3), (5, 9, None), (1, 4, None), (30, 1, None)])
def test_rank_one_updates_give_the_spectrum_of_all_rows(streams, rows, size, rank):
    x = np.floor(vector_rows(rows, rows, size, rank) * 256)
    kept = spectra.Spectra(streams, size)
    kept.take(x)
    one = kept.joined()
    off = x - x.mean(0)
    scale = max(1.0, direct_spectrum(x).max())
    assert np.allclose(one.values[0], direct_spectrum(x), atol=1e-12 * scale)
    assert np.allclose(one.basis[0].T @ one.basis[0], np.eye(size), atol=1e-12)
    assert np.allclose((one.basis[0] * one.values[0]) @ one.basis[0].T, off.T @ off, atol=1e-12 * scale)
    assert one.count[0] == rows and np.allclose(one.mean[0], x.mean(0))


def test_equal_values_and_zero_weights_are_deflated():
    values = np.array([[1.0, 1.0, 1.0, 2.0], [0.0, 0.0, 0.0, 0.0]])
    basis = np.tile(np.eye(4), (2, 1, 1))
    u = np.array([[1.0, 2.0, 0.0, 0.0], [0.0, 3.0, 0.0, 4.0]])
    got, vectors = spectra.rank_one(values, basis, u)
    for k in range(2):
        whole = np.diag(values[k]) + np.outer(u[k], u[k])
        assert np.allclose(got[k], np.linalg.eigvalsh(whole))
        assert np.allclose((vectors[k] * got[k]) @ vectors[k].T, whole)


@pytest.mark.parametrize("rank", [None, 2])
def test_whitening_equals_direct_eigenvectors(spark, rank):
    values = vector_rows(7, 300, 64, rank)
    df = odd_vectors(spark, np.round(values * 16) / 16 if rank is None else values)
    rows = kept_vectors(df)
    x = np.stack([v for _, v in rows])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    off = fit - sums / n
    energy, vectors = np.linalg.eigh(off.T @ off / n)
    energy, vectors = energy[::-1][:4], vectors[:, ::-1][:, :4]
    got = whitening.whiten(df).toPandas()
    assert len(got) == 4 * len(rows) and set(got["n"]) == {n}
    assert sorted(got["deviation"]) == sorted(np.repeat(((n * x - sums) ** 2).sum(1), 4))
    direct = (x - sums / n) @ vectors / np.sqrt(energy)
    for i in range(4):
        mine = got[got["component"] == i + 1]
        assert np.allclose(mine["explained"], energy[i] / np.trace(off.T @ off / n))
        assert np.allclose(np.sort(np.abs(mine["whitened"])), np.sort(np.abs(direct[:, i])), atol=1e-8)
    assert (got["identity_error"] < 1e-9).all()


def test_whitening_without_variance_or_rows(spark):
    same = spark.createDataFrame([(i, [0.5, 0.25], 1, "a", 2, 3) for i in range(3)], VECTORS)
    got = whitening.whiten(same).collect()
    assert len(got) == 6 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in got)
    line = spark.createDataFrame([(i, [i / 4, 0.0], 1, "a", 2, 3) for i in range(8)], VECTORS)
    got = whitening.whiten(line).collect()
    assert {r["component"]: r["whitened"] is None for r in got} == {1: False, 2: True}
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    large = spark.createDataFrame([(1, [1e30, 0.0], 1, "a", 2, 3), (2, [0.0, 0.0], 1, "a", 2, 3)], VECTORS)
    assert {r["deviation"] for r in whitening.whiten(large).collect()} == {None}


def test_states_join_in_a_tree(spark, monkeypatch):
    values = np.floor(vector_rows(5, 120, 6) * 256).astype(int)
    fit = spark.createDataFrame([([int(c) for c in v],) for v in values], "x array<long>").repartition(40)
    n, sums, basis = whitening.whole_spectrum(fit, 6)
    assert n == 120 and sums == values.sum(0).tolist()
    off = values - values.mean(0)
    diagonal = basis.T @ (off.T @ off) @ basis
    assert np.allclose(diagonal, np.diag(np.diag(diagonal)), atol=1e-6 * diagonal.max())


def test_sums_and_deviations_beyond_a_long():
    huge = (1 << 62) + 5
    state = [whitening.state_frame(i, 1, [huge >> 32], [huge & whitening.LOW], spectra.Spectra(1, 1)) for i in range(3)]
    row = whitening.join_states(pd.concat(state)).iloc[0]
    assert row["high"][0] * (1 << 32) + row["low"][0] == 3 * huge
    x = np.array([[3_000_000_000], [1]])
    assert whitening.deviations(x, 2, [3_000_000_001]).to_pylist() == [2999999999**2, 2999999999**2]
    assert whitening.deviations(x * 2, 2, [0]).to_pylist() == [None, 16]


def brute_clusters(rows, k, rounds):
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1].tolist()))
    centres = [r[1].astype(object) for r in order[:k]]
    x = [r[1].astype(object) for r in rows]

    def nearest():
        return [min((((v - c) ** 2).sum(), i) for i, c in enumerate(centres)) for v in x]

    for _ in range(rounds):
        best = nearest()
        for i in range(len(centres)):
            own = [v for v, b in zip(x, best) if b[1] == i]
            if own:
                centres[i] = sum(own) // len(own)
    return nearest(), centres


@pytest.mark.parametrize("k", [5, 40, 500])
def test_centroids_equal_brute_force(spark, k):
    df = odd_vectors(spark, vector_rows(3, 120))
    rows = kept_vectors(df)
    best, centres = brute_clusters(rows, k, 5)
    found = centroids.cluster_vectors(df, k=k)
    got = sorted(map(tuple, centroids.clusters_with_inertia(found).collect()), key=repr)
    total = sum(d for d, _ in best)
    want = [
        (r[0], c, d, sum(e for e, i in best if i == c), total,
         hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest())
        for r, (d, c) in zip(rows, best)
    ]
    assert got == sorted(want, key=repr)
    assert found.centroids == [c.tolist() for c in centres]


def test_centroids_of_no_or_too_large_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    assert centroids.clusters_with_inertia(centroids.cluster_vectors(none)).count() == 0
    large = spark.createDataFrame([(1, [1e9] * 64, 1, "a", 2, 3)], VECTORS)
    with pytest.raises(ValueError):
        centroids.cluster_vectors(large)


def test_centroid_plans_hold_no_python(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    plan = centroids.clusters_with_inertia(centroids.cluster_vectors(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_centroid_query_equals_sql(spark):
    build, sql = queries.QUERIES["op13_centroids"], queries.CHECKS["op13_centroids"]
    assert compare(spark, connect(FOLDER), "op13_centroids", build, sql, FOLDER) == []


TEXT = "The same words in every copy of this text. "
ODD = [(i, TEXT, "en") for i in range(150)] + [(None, TEXT, None)] * 200 + [
    (900, None, None), (901, "", "x"), (901, "", "x"), (902, None, "x"), (903, "été 漢字", "fr"), (904, "w " * 300_000, "en"),
    (905, "a", None), (905, None, "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in ODD], DOCS).repartition(4)


@pytest.mark.parametrize("bucket_bytes", [1 << 30, 2000])
def test_shards_hold_every_row_once(spark, odd, bucket_bytes):
    folder = shards.write_shards(odd, 16, bucket_bytes=bucket_bytes)
    got = shards.read_shards(spark, folder, odd.schema).collect()
    assert sorted((tuple(r["record"]) for r in got), key=repr) == sorted(map(tuple, odd.collect()), key=repr)
    sizes = {}
    for r in got:
        sizes.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in sizes.values())
    assert len(sizes) == 16 and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1


def test_shard_order_is_that_of_the_rows_and_the_seed(spark, odd):
    def places(df, seed=12):
        folder = shards.write_shards(df, 4, seed=seed, bucket_bytes=4000)
        rows = shards.read_shards(spark, folder, df.schema)
        return sorted(((r["shard"], r["slot"], tuple(r["record"])) for r in rows.collect()), key=repr)

    first = places(odd)
    assert first == places(odd.repartition(9)) and first != places(odd, seed=13)


def test_shards_are_shuffled(spark):
    df = spark.range(2000).selectExpr("id AS doc_id", "string(id) AS text")
    rows = shards.document_slots(df, 1).toPandas().sort_values("slot")
    order = rows["doc_id"].to_numpy()
    assert sorted(order) == list(range(2000))
    assert abs(np.corrcoef(order, np.arange(2000))[0, 1]) < 0.1
    assert (np.diff(order) == 1).mean() < 0.01


def test_document_slots_digest_the_written_files(spark, odd):
    got = shards.document_slots(odd).collect()
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in ODD), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == want
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


def test_shards_of_few_rows(spark):
    none = spark.createDataFrame([], DOCS)
    assert shards.document_slots(none).count() == 0
    three = spark.createDataFrame([(i, "t", "en", 1, 2, 3, 4, 5, 6) for i in range(3)], DOCS)
    got = shards.document_slots(three).collect()
    assert len(got) == 3 and len({r["shard"] for r in got}) == 3 and {r["slot"] for r in got} == {0}
