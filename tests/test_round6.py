"""Disk of the text weights, memory of wide dictionaries, clusters of small components."""

import math
import os
from collections import Counter, defaultdict

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sessionloom.cluster import shared_dir
from sessionloom.operators import encode, textsim


def weights_by_hand(rows):
    """Entries of each id over all its texts, each text counted by itself."""
    tf = [(i, Counter((t or "").split())) for i, t in rows]
    df = Counter(t for _, c in tf for t in c)
    raw = defaultdict(list)
    for i, c in tf:
        raw[i] += [(t, n * (math.log((len(rows) + 1) / (df[t] + 1)) + 1)) for t, n in c.items()]
    out = []
    for i, entries in raw.items():
        size = math.sqrt(sum(w * w for _, w in entries))
        out += [(repr(i), t, round(w / size, 9)) for t, w in entries]
    return sorted(out)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_weights_of_repeated_and_missing_ids(spark, monkeypatch, block):
    monkeypatch.setattr(textsim, "BLOCK_TEXTS", block)
    rows = [(1, "aa bb aa"), (1, "bb cc"), (None, "aa dd"), (None, "dd ee ee"), (2, "aa"), (3, ""), (4, None)]
    rows += [(10 + i, f"aa w{i} w{i // 2} w{i // 2}") for i in range(20)]
    docs = spark.createDataFrame(rows, "id long, text string").coalesce(2)
    got = sorted((repr(r["id"]), r["term"], round(r["w"], 9)) for r in textsim.tfidf(docs, "id", "text").collect())
    assert got == weights_by_hand(rows)


def test_weights_in_long_form_write_each_word_of_a_block_once(spark):
    folder = shared_dir(spark).replace("file:", "")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    texts = spark.range(400).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: F.concat(
        F.lit("quitealongword"), (F.col("id") * 13 + i).cast("string")))).alias("text"))
    assert textsim.tfidf(texts.coalesce(1), "id", "text").count() == 400 * 300
    left = [x for x in set(os.listdir(folder)) - before]
    assert not [x for x in left if x.startswith(("terms-", "vectors-"))]
    read = [spark.read.parquet(f"{folder}/{x}") for x in left if x.startswith("blocks-")]
    words = sum(b.select(F.sum(F.size("words")).alias("n")).where("n > 0").first()["n"] for b in read)
    assert words == 399 * 13 + 300


def test_wide_dictionaries_have_no_name_for_each_place(spark, monkeypatch):
    df = spark.createDataFrame([("a",), ("c",), (None,), ("b",), ("c",), ("d",)], "v string")
    named = encode.one_hot_vector(df, "v", "x", fit_on=df.where("v <> 'd'"), code="at")
    monkeypatch.setattr(encode, "NAMED_PLACES", 2)
    wide = encode.one_hot_vector(df, "v", "x", fit_on=df.where("v <> 'd'"), code="at")
    assert wide.dtypes == named.dtypes
    assert sorted(map(repr, wide.collect())) == sorted(map(repr, named.collect()))
    assert {r["at"]: r["total"] for r in encode.vector_totals(wide, "x").collect()} == {0: 1.0, 1: 1.0, 2: 2.0}
    assert encode.vector_totals(named, "x").count() == 3
    monkeypatch.undo()
    many = encode.one_hot_vector(spark.range(20_001), "id", "x")
    assert len(many.schema["x"].json()) < 1000
    assert VectorAssembler(inputCols=["x"], outputCol="y").transform(many).first()["y"].size == 20_001


@pytest.mark.parametrize("kind", ["long", "int", "smallint", "string"])
def test_pairs_have_the_hash_of_spark(spark, kind):
    df = spark.createDataFrame([(-5, 7), (0, 123456), (30000, 2), (11111, 22222)], "a long, b long")
    if kind == "string":
        df = df.select(*[F.concat(F.lit("a long word of pé "), F.repeat(F.col(c).cast("string"), 9)).alias(c) for c in "ab"])
    else:
        df = df.where(F.col("b") < 30000).select(*[F.col(c).cast(kind) for c in "ab"])
    table = df.withColumn("h", F.xxhash64("a", "b")).toArrow()
    assert [textsim._pair_hash(a, b) for a, b in zip(table["a"], table["b"])] == table["h"].to_pylist()


@pytest.mark.parametrize("ids, cut, few", [("long", 0.2, "TIE_ROWS"), ("string", 0.5, "TIED_LINKS")])
def test_clusters_merged_in_one_task_are_those_of_the_rounds(spark, monkeypatch, ids, cut, few):
    rows = []
    for i in range(80):  # chains, copies and many equal similarities
        words = [f"w{(i // 8) * 5 + k}" for k in range(8 + i % 3)] + ["all"] + [f"x{i % 4}"] * (i % 2)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "id long, text string").withColumn("id", F.col("id").cast(ids))
    vectors = textsim.tfidf_vectors(docs, "id", "text", shared=True)
    jobs = []
    monkeypatch.setattr(textsim, "_renamed", lambda *a, f=textsim._renamed: jobs.append(1) or f(*a))
    found = lambda: {r["id"]: r["cluster"] for r in textsim.linkage_clusters(vectors, cut).collect()}
    at_once = found()
    assert not jobs and 1 < len(set(at_once.values())) < 80
    monkeypatch.setattr(textsim, few, 1)
    assert found() == at_once and jobs


def test_similar_pairs_in_parts_leave_little_on_the_disk(spark, monkeypatch):
    rows = [(i, " ".join([f"w{(i // 6) * 7 + k}" for k in range(30 - i % 4)] + ["common"])) for i in range(90)]
    vectors = textsim.tfidf_vectors(spark.createDataFrame(rows, "id long, text string"), "id", "text", shared=True)
    whole = {(r["a"], r["b"]): r["sim"] for r in textsim.similar_pairs(vectors, 0.8).collect()}
    folder, parts = shared_dir(spark).replace("file:", ""), []
    for name, few in (("MEETINGS", 400), ("HEAD_MEETINGS", 1), ("MOVED_PAIRS", 40)):
        monkeypatch.setattr(textsim, name, few)
    seen = lambda pairs, *a, f=textsim.near_pairs: parts.append(pairs.count()) or f(pairs, *a)
    monkeypatch.setattr(textsim, "near_pairs", seen)
    before = set(os.listdir(folder))
    got = {(r["a"], r["b"]): r["sim"] for r in textsim.similar_pairs(vectors, 0.8).collect()}
    left = [x.split("-")[0] for x in set(os.listdir(folder)) - before]
    assert len(parts) > 1 and max(parts) < sum(parts)
    assert got.keys() == whole.keys() and all(abs(got[k] - whole[k]) < 1e-12 for k in whole)
    assert "heads" not in left and left.count("candidates") == 1 and left.count("placed") == 1
    assert "outlines" not in left and left.count("near") > len(parts)
