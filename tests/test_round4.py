"""Similar texts: what is moved and kept on disk, against brute force."""

import math
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sessionloom.cluster import shared_dir
from sessionloom.operators import textsim

ENTRIES = "id long, entries array<struct<df: long, term: string, w: double>>"


def texts_of(spark):
    rows = []
    for i in range(240):
        base = [f"w{(i // 6) * 7 + k}x{k % 5}" for k in range(40)] + ["common", "words"] * (1 + i % 3)
        rows.append((i, " ".join(base[: 40 - i % 6] + [f"own{i}"] * (i % 2) + base[40:])))
    return spark.createDataFrame(rows + [(500, None), (501, "? !"), (502, "common words")], "id long, text string")


def brute(rows, least):
    tf = {r["id"]: Counter(re.findall(r"\b\w\w+\b", (r["text"] or "").lower())) for r in rows}
    df = Counter(t for c in tf.values() for t in c)
    w = {}
    for i, c in tf.items():
        raw = {t: n * (math.log((len(rows) + 1) / (df[t] + 1)) + 1) for t, n in c.items()}
        size = math.sqrt(sum(x * x for x in raw.values()))
        w[i] = {t: x / size for t, x in raw.items()}
    out = {}
    for a in w:
        for b in w:
            sim = sum(x * w[b].get(t, 0) for t, x in w[a].items())
            if a < b and sim >= least:
                out[a, b] = sim
    return out


@pytest.mark.parametrize("least", [0.9, 0.5])
@pytest.mark.parametrize("cells", [None, 60])
def test_similar_pairs_equal_brute_force(spark, monkeypatch, least, cells):
    if cells:  # many groups, and grids of cells in most of them
        for name in ("BLOCK_TEXTS", "CELL_ROWS", "CELL_PAIRS", "CELL_ENTRIES", "HOT_ROWS"):
            monkeypatch.setattr(textsim, name, cells)
    docs = texts_of(spark)
    vectors = textsim.tfidf_vectors(docs, "id", "text", shared=True)
    got = {(r["a"], r["b"]): r["sim"] for r in textsim.cosine_pairs(vectors, least).collect()}
    want = brute(docs.collect(), least)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_pair_that_cannot_reach_the_cut_is_no_candidate(spark):
    rows = [
        (1, [(2, "x", 0.05), (9, "y", math.sqrt(1 - 0.05**2))]),
        (2, [(2, "x", 0.6), (9, "y", 0.8)]),
        (3, [(2, "z", 0.6), (9, "y", 0.8)]),
        (4, [(2, "z", 0.6), (9, "y", 0.8)]),
    ]
    vectors = spark.createDataFrame(rows, ENTRIES)
    assert [tuple(r) for r in textsim.candidate_pairs(vectors, 0.9).collect()] == [(3, 4)]


def test_tables_that_nothing_reads_any_more_are_deleted(spark):
    folder = shared_dir(spark).replace("file:", "")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    vectors = textsim.tfidf_vectors(texts_of(spark), "id", "text", shared=True)
    textsim.cosine_pairs(vectors, 0.9).collect()
    left = set(os.listdir(folder)) - before
    assert not [x for x in left if x.startswith(("terms-", "heads-"))]


def test_texts_that_differ_in_words_of_their_own_stay_apart(spark):
    docs = spark.createDataFrame([(1, "aa bb cc dd"), (2, "aa bb cc ee"), (3, "bb aa ff"), (4, "aa bb ff")], "id long, text string")
    vectors = textsim.tfidf_vectors(docs, "id", "text", shared=True)
    groups = {r["id"]: r["same_as"] for r in textsim.vector_groups(vectors).collect()}
    assert groups == {1: 1, 2: 2, 3: 3, 4: 3}
    full = textsim.tfidf_vectors(docs, "id", "text")
    clusters = lambda v: {r["id"]: r["cluster"] for r in textsim.linkage_clusters(v, 0.5).collect()}
    assert clusters(vectors) == clusters(full)
    assert full.select(F.sum(F.size("entries"))).first()[0] == 14


def test_token_files_hold_more_parts_and_ids_do_not_depend_on_it():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    np = pytest.importorskip("numpy")
    from sessionloom.llm import token_files, tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    data = np.frombuffer(" ".join(f"word{i % 70} text{i}" for i in range(400)).encode(), np.uint8)
    edges = np.array([0, 50, len(data)])
    few, many = (tokens.encoder(path, keep=k) for k in (20, token_files.KEEP))
    assert (few.keep, many.keep) == (20, token_files.KEEP) and token_files.KEEP > tokens.KEEP
    for x, y in zip(few.encode(data, edges), many.encode(data, edges)):
        assert x.tolist() == y.tolist()


def test_vectors_with_a_term_twice_are_compared_by_neighbours(spark):
    """Under a repeated id a term comes twice: such pairs are neither cut early nor compared otherwise."""
    rows = [
        (1, [(4, "x", 0.1), (4, "x", 0.7), (9, "y", 0.7)]),
        (2, [(4, "x", 0.5), (4, "x", 0.6), (9, "y", 0.6)]),
        (3, [(4, "x", 0.2), (9, "y", 0.9)]),
    ]
    vectors = spark.createDataFrame(rows, ENTRIES)
    got = {(r["a"], r["b"]): r["sim"] for r in textsim.similar_pairs(vectors, 0.6).collect()}
    want = {(1, 2): 0.1 * 0.5 + 0.5 * 0.6 + 0.6 * 0.7 + 0.6 * 0.7, (1, 3): 0.1 * 0.2 + 0.2 * 0.7 + 0.7 * 0.9,
            (2, 3): 0.2 * 0.5 + 0.5 * 0.6 + 0.6 * 0.9}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
