"""The operators against brute force on small tables, with odd rows, and the queries with SQL."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sessionloom.llm import (
    arrays,
    fingerprints, langid, licenses, lm_score, mixing, near_dedup, packing, quality, queries, token_counts, token_files,
    tokens,
)
from tests.checker import compare, connect

FOLDER = os.environ.get("CHECK_DIR", "/root/testdata/sf0.001")
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, part int, kept boolean"
ODD = [
    (1, "The cat sat on the mat and the dog sat on the log by the old door of the house near the river", "en", "a"),
    (2, "The cat sat on the mat and the dog sat on the log by the old door of the house near the river", "en", "a"),
    (2, "The cat sat on the mat and the dog sat on the log by the old door of the house near the river", "en", "a"),
    (3, None, None, None), (4, "", "en", "b"), (5, " \n\t ", "de", None), (6, "one", "en", "b"),
    (None, "no id but words that are here", "en", "a"), (7, LONG, "en", "c"), (8, LONG + " end", None, "c"),
    (9, "### $$$ %%% 123 456", "fr", "d"), (10, "a\nb\n\na\nb\n", "fr", "d"), (11, "été à la plage  où", "fr", "d"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, 2, 3, True) for r in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


APPLIED = {
    "near": near_dedup.near_groups,
    "deduplicated": near_dedup.deduplicated,
    "pack": lambda d: packing.pack(d, queries.WORD_TOKENIZER, 2),
    "fingerprints": fingerprints.fingerprints,
    "lm": lm_score.pseudo_likelihood,
    "mix": lambda d: mixing.mix(d).taken,
    "mixed": mixing.mixed_documents,
    "language": lambda d: langid.identify(d, queries.BYTE_TOKENIZER),
    "quality": quality.quality_rules,
    "licenses": licenses.license_scan,
    "files": lambda d: token_files.read_token_files(token_files.write_token_files(d, queries.BYTE_TOKENIZER, 2)),
    "counts": lambda d: token_counts.section_token_counts(d, queries.BYTE_TOKENIZER),
}


@pytest.mark.parametrize("name", sorted(APPLIED))
def test_odd_rows(odd, name):
    rows = APPLIED[name](odd).collect()
    if name not in ("deduplicated", "pack", "mixed"):
        assert len(rows) == len(ODD)
    if name == "near":
        by = {r.doc_id: r for r in rows}
        assert by[2].component_id == 1 and not by[2].kept and by[8].component_id == 7
        assert by[3].n_shingles == 0 and by[3].kept and by[6].n_shingles == 1 and by[None].component_id is None
    if name == "deduplicated":
        assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 3, 4, 5, 6, 7, 9, 10, 11]
    if name == "language":
        assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (3, 4, 5, 9)} == dict.fromkeys((3, 4, 5, 9), "und")
    if name == "mix":
        assert all(r.taken <= 2 * r["size"] for r in rows) and sum(r.taken for r in rows) > 0
    if name == "lm":
        assert all((r.mean_log_prob is None) == (r.n_tokens == 0) for r in rows)


@pytest.mark.parametrize("name", sorted(APPLIED))
def test_empty_table(empty, name):
    assert APPLIED[name](empty).count() == 0


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_queries_equal_sql(spark, name):
    assert compare(spark, connect(FOLDER), name, queries.QUERIES[name], queries.CHECKS[name], FOLDER) == []


@pytest.mark.parametrize("spans", [False, True])
@pytest.mark.parametrize("name", [queries.BYTE_TOKENIZER, queries.WORD_TOKENIZER])
def test_ids_of_texts_with_added_tokens_equal_the_plain_library(name, spans):
    """Whole texts through the library as it is; the store overflows on the way."""
    import random

    import pyarrow as pa

    draw, plain = random.Random(3), Tokenizer.from_file(name)
    parts = ["a", "B", " ", "  ", "\n", "\t", "<|endoftext|>", "<|startoftext|>", "<|end", "|>", "\u00a0", "\u3000", "é", "1", "'s"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(14))) for _ in range(3000)]
    coder = tokens.TextEncoder(name, spans, keep=300)
    for low in range(0, len(texts), 300):
        for first, end, data, edges in arrays.blocks(pa.array(texts[low : low + 300])):
            found = coder.encode(data, edges)
            for i, text in enumerate(texts[low + first : low + end]):
                own, want = slice(found[1][i], found[1][i + 1]), plain.encode(text, add_special_tokens=False)
                assert found[0][own].tolist() == want.ids, text
                if spans:
                    assert list(zip(found[2][own].tolist(), found[3][own].tolist())) == [tuple(o) for o in want.offsets]


def encoded(name, text):
    return np.array(Tokenizer.from_file(name).encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def test_token_files_round_trip(odd):
    shards = token_files.write_token_files(odd, queries.BYTE_TOKENIZER, 2)
    rows = sorted(token_files.read_token_files(shards, with_ids=True).collect(), key=lambda r: r.start)
    at = 0
    for row, (key, text, *_) in zip(rows, sorted(ODD, key=lambda r: (r[0] or -1, r[1] or ""))):
        ids = encoded(queries.BYTE_TOKENIZER, text)
        assert (row.doc_id, row.start, row.n_tokens) == (key, at, len(ids))
        assert row.ids == ids.tolist() and row.ids_crc32 == zlib.crc32(ids.tobytes())
        at += len(ids)


def test_packing_holds_every_id_once(odd):
    rows = packing.pack(odd, queries.WORD_TOKENIZER, 2, with_ids=True).collect()
    texts = defaultdict(list)
    for key, text, *_ in ODD:
        texts[key].append(text)
    got, sequences = Counter(), defaultdict(list)
    for r in rows:
        ids = encoded(queries.WORD_TOKENIZER, texts[r.doc_id][0])
        assert r.ids == ids[r.start : r.start + r.length].tolist() and r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        got[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == {k: sum(len(encoded(queries.WORD_TOKENIZER, t)) for t in v) for k, v in texts.items()}
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096


def test_quick_hashes_depend_on_the_word_alone():
    text = b"Ab cd  abcd\tAB ab " + b"x" * 50 + b" cd \xc3\xa9 cD"
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = arrays.word_spans(data, np.array([0, len(text)]))
    words = [text[a:b].lower() for a, b in zip(starts, ends)]
    whole = arrays.quick_word_hashes(data, starts, ends)
    for most in (1, 7, 40):
        assert (arrays.quick_word_hashes(data, starts, ends, most) == whole).all()
    assert len(set(zip(words, whole.tolist()))) == len(set(words)) == len(set(whole.tolist()))
    none = np.zeros(0, np.int64)
    assert len(arrays.quick_word_hashes(np.zeros(0, np.uint8), none, none)) == 0


def test_hilbert_neighbours_touch():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert(cells, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("part_bytes", [1 << 30, 50_000])
def test_fingerprints_follow_edits(docs, part_bytes):
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    keys = sorted(texts)
    rows = {r.doc_id: r for r in fingerprints.fingerprints(docs, part_bytes=part_bytes).collect()}
    assert sorted(rows) == keys
    for key, following in zip(keys, keys[1:] + keys[:1]):
        text = fingerprints.edited(texts[key], texts[following])
        assert rows[key].edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert rows[key].n_chars == len(texts[key]) and 0 <= rows[key].near_next <= 1
    assert np.median([r.near_edited for r in rows.values()]) > 0.5 > 0.1 > np.median([r.near_next for r in rows.values()])


def test_peeled_digests_are_the_differences():
    rng = np.random.default_rng(1)
    sets = [rng.choice(400, rng.integers(0, 300), replace=False).astype(np.uint64) for _ in range(60)]
    digests = [fingerprints.mixed(s, 1) for s in sets]

    def joined(some):
        return fingerprints.Digests(np.concatenate(some), np.cumsum([0, *map(len, some)]))

    want = [len(set(a.tolist()) ^ set(b.tolist())) for a, b in zip(digests[:-1], digests[1:])]
    assert fingerprints.differing(joined(digests[:-1]), joined(digests[1:])).tolist() == want


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = [r for r in langid.identify(docs, queries.BYTE_TOKENIZER).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert np.mean([r.lang_pred == known[r.doc_id] for r in rows]) > 0.97


def test_marginals_equal_all_segmentations():
    pieces = langid.piece_table(queries.BYTE_TOKENIZER)
    chances = np.random.default_rng(0).random((pieces.count, 1)) / pieces.count
    number = {n: i for i, n in enumerate(pieces.names)}

    def total(word):
        return 1.0 if not word else sum(
            chances[number[word[:k]], 0] * total(word[k:]) for k in range(1, len(word) + 1) if word[:k] in number
        )

    words = [b" the", b" station", b" \xc3\xa9t\xc3\xa9", b" zqx"]
    got = langid.log_marginals(words, langid.scaled(chances, pieces), pieces)[:, 0]
    assert np.allclose(got, [np.log(total(w)) for w in words])


def test_signatures_in_reach_share_a_key():
    rng = np.random.default_rng(3)
    masks = [m & (2**64 - 1) for _, m in near_dedup.masks(1)]
    for _ in range(300):
        a = rng.integers(0, 1 << 16, 32).astype(np.uint16)
        b = a.copy()
        b[rng.choice(32, near_dedup.MOST_DIFFERENT, replace=False)] += 1
        x, y = a.view(np.uint64), b.view(np.uint64)
        assert any(int(p) & m == int(q) & m for p, q in zip(x, y) for m in masks)


@pytest.mark.parametrize("limit", [1, 20_000])
def test_split_keys_lose_no_link(spark, limit):
    rng = np.random.default_rng(5)
    base, rows = [f"w{i}" for i in range(120)], []
    for k in range(60):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 9), replace=False):
            words[at] = f"v{rng.integers(0, 40)}"
        rows.append((k, " ".join(words)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    home = list(range(60))
    for a in range(60):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(home[a], home[b]), min(home[a], home[b])
                home = [new if h == old else h for h in home]
    found = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), "text", limit, 200 * limit)
    assert {r.doc_id: r.component_id for r in found.collect()} == dict(enumerate(home))


def test_section_counts(docs):
    tokenizer = Tokenizer.from_file(queries.BYTE_TOKENIZER)
    texts = {r.doc_id: r.text for r in docs.limit(40).collect()}
    for row in token_counts.section_token_counts(docs.limit(40), queries.BYTE_TOKENIZER).collect():
        lines = re.findall(r"[^\n]*\n|[^\n]+$", texts[row.doc_id])
        heads, want = np.cumsum([0, *map(len, lines)]), np.zeros(len(lines), int)
        for begin, _ in tokenizer.encode(texts[row.doc_id], add_special_tokens=False).offsets:
            want[np.searchsorted(heads, begin, "right") - 1] += 1
        assert row.section_tokens == want.tolist() and sum(want) == row.n_tokens


def test_longest_rule_gives_a_token_to_most_of_its_characters():
    args = np.array([0, 2]), np.array([2, 7]), np.array([0, 2]), np.array([0, 3]), np.array([0, 2])
    assert token_counts.attribute(*args, "start")[0].tolist() == [2, 0]
    assert token_counts.attribute(*args, "longest")[0].tolist() == [1, 1]


def test_kept_documents_are_those_with_a_verdict(docs, odd):
    for table in (docs, odd):
        rows = quality.quality_rules(table.withColumnRenamed("kept", "_old") if "kept" in table.columns else table)
        want = sorted(str(r.doc_id) for r in rows.where("kept").collect())
        found = quality.kept_documents(table)
        assert found.columns == table.columns and sorted(str(r.doc_id) for r in found.collect()) == want
    assert quality.kept_documents(odd.limit(0)).count() == 0


def test_texts_in_no_language_learned_go(spark, docs):
    import random

    draw = random.Random(5)
    junk = ["".join(draw.choice("bcdfghjklmnpqrstvwxz ") for _ in range(300)) for _ in range(4)]
    junk += ["これは日本語の文章です。東京は日本の首都であり、多くの人が住んでいます。", "Это текст на русском языке о погоде и море. " * 3]
    model = langid.train(langid.in_training(docs), queries.BYTE_TOKENIZER)
    strange = spark.createDataFrame([(i, t, "x") for i, t in enumerate(junk)], "score long, text string, _row string")
    assert langid.kept_documents(strange, model, 0.0, 2.0).count() == 0
    assert langid.kept_documents(strange, model, 0.0, 20.0).orderBy("score").collect() == strange.orderBy("score").collect()
    plain = docs.where("lang IS NOT NULL AND regexp_count(text, '[a-z]{3}') > 20")
    assert langid.kept_documents(plain, model, 0.0, 2.0).count() == plain.count()


def test_training_ids_are_the_smallest_hashes(spark):
    from pyspark.sql import functions as F

    rows = spark.range(5000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "b").when(F.col("id") % 97 == 0, "c").otherwise("a").alias("lang")
    )
    hashed = sorted((r.h, r.doc_id, r.lang) for r in rows.select("*", F.xxhash64("doc_id").alias("h")).collect())
    want = sorted((l, i) for l in "ab" for _, i, m in [x for x in hashed if x[2] == l][:300])
    assert sorted((r.lang, r.doc_id) for r in langid.training_ids(rows, 300, 2).collect()) == want


def test_columns_with_the_names_of_helpers_stay(odd):
    names = ["_key", "_copies", "_copy", "_q_text", "_q_h", "_row", "_mark", "_kept", "score", "surprise", "lang_pred"]
    wide = odd.selectExpr("*", *[f"concat('{n}', doc_id) AS {n}" for n in names])
    for found in (mixing.mixed_documents(wide), quality.kept_documents(wide)):
        assert found.columns == wide.columns
        for row in found.where("doc_id IS NOT NULL").collect():
            assert all(row[n] == f"{n}{row.doc_id}" for n in names)
    measured = quality.quality_rules(wide)
    assert {r._q_text for r in measured.where("doc_id = 1").collect()} == {"_q_text1"}


def test_a_worker_holds_the_store_of_one_operator():
    tokens.encoder(queries.BYTE_TOKENIZER)
    assert tokens.encoder(queries.BYTE_TOKENIZER) is tokens.encoder(queries.BYTE_TOKENIZER) and arrays.held_for("tokens")
    arrays.held_for("language")
    assert not arrays.held_for("tokens")


def found_licenses(known, text, least=0.75):
    return known.scan(known.numbers([w.encode() for w in text.split()]), least)


def test_license_alignment():
    known = licenses.Templates(licenses.TEMPLATES)
    text = "intro of the text. " * 30 + licenses.TEMPLATES["MIT"].text.replace("sublicense", "lend") + " outro" * 20
    found = found_licenses(known, text)
    assert [f[0] for f in found] == ["MIT"] and 0.95 < found[0][1] < 1 and found[0][2] == 120
    assert licenses.aligned(list("xaybzc"), list("abc")) == [(1, 0), (3, 1), (5, 2)]


NEAR_NAMES = [
    ("Released under the MIT License.", ["MIT-notice"]), ("Released under the BSD License.", ["BSD-notice"]),
    ("Released under the WTF License.", []), ("Licensed under CC BY 4.0.", ["CC-BY-4.0-notice"]),
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0-notice"]), ("Licensed under CC BY-NC 3.0.", []),
    ("Licensed under the Apache License, Version 1.1", ["Apache-1.1-notice"]),
    ("Licensed under the Apache License, Version 2.0", ["Apache-2.0-notice"]),
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0-notice"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-notice"]),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0-notice"]),
    ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0-notice"]),
    ("This work is licensed under the GNU Lesser General Public License, version 7.", []),
]


def test_licenses_of_near_names_are_told_apart():
    known = licenses.Templates(licenses.TEMPLATES)
    for text, names in NEAR_NAMES:
        assert [f[0] for f in found_licenses(known, "some words before it. " + text + " some words after.")] == names, text
    for name, license in licenses.TEMPLATES.items():  # every template is found as itself and as nothing else
        found = found_licenses(known, license.text)
        assert [(f[0], f[1]) for f in found] == [(name, 1.0)], name
    advertising = licenses.BSD_CONDITIONS + "3. All advertising materials mentioning features. " + licenses.BSD_NAMES
    assert found_licenses(known, advertising + licenses.BSD_NO_WARRANTY) == []


def test_all_places_of_a_license_are_found():
    known = licenses.Templates(licenses.TEMPLATES)
    line, mit = "Released under the MIT License. ", licenses.TEMPLATES["MIT"].text + " "
    size = len(mit.split())
    assert [f[2] for f in found_licenses(known, line * 7)] == [0, 5, 10, 15, 20, 25, 30]
    found = found_licenses(known, mit + "x " * 40 + line + mit + mit)
    assert sorted((f[2], f[0]) for f in found) == [
        (0, "MIT"), (size + 40, "MIT-notice"), (size + 45, "MIT"), (2 * size + 45, "MIT")
    ]


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_license_coverage_against_the_longest_common_subsequence():
    import random

    draw, known = random.Random(11), licenses.Templates(licenses.TEMPLATES)
    for turn in range(60):
        name = draw.choice(["MIT", "BSD-3-Clause", "GPL-3.0", "Apache-2.0", "Zlib"])
        t = known.names.index(name)
        text = [w for w in licenses.TEMPLATES[name].text.split()]
        for _ in range(draw.randrange(1, 14)):
            at = draw.randrange(len(text))
            text[at : at + draw.randrange(2)] = draw.choice([[], ["other"], ["words", "added"], ["the"]])
        numbers = known.numbers([w.encode() for w in text])
        pairs = licenses.aligned(numbers.tolist(), known.words[t].tolist())
        best = longest_common(numbers.tolist(), known.words[t].tolist())
        assert all(numbers[i] == known.words[t][j] for i, j in pairs)
        assert pairs == sorted(set(pairs)) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))
        assert best >= len(pairs) >= 0.97 * best, (name, turn, len(pairs), best)
        placed = [f for f in known.scan(numbers, 0.75) if f[0] == name]
        told = known.tells(t, numbers, pairs, 0)
        assert len(placed) == told and (not told or abs(placed[0][1] * known.sizes[t] - best) <= 0.04 * best)


def test_every_window_is_trained_on(spark, odd):
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in ODD)
    texts = lm_score.encoded_texts(odd)
    counts = lm_score.bucket_counts(texts)
    assert counts.sum() == words
    runs = list(lm_score.decoded(texts.toArrow().column("ids").combine_chunks()))
    assert (sum(np.bincount(r[2], minlength=len(counts)) for r in runs) == counts).all()
    assert sum(r[3][-1] for r in runs) == words
    for word in ("one", "two", "three"):  # a text of one word is one window
        texts = lm_score.encoded_texts(spark.createDataFrame([(1, word)], "doc_id long, text string"))
        fresh = lm_score.fresh_network(lm_score.bucket_counts(texts), 3)
        assert (lm_score.trained(texts, rounds=1).table != fresh.table).any()


def _small_network():
    random = np.random.default_rng(5)
    network = lm_score.fresh_network(random.integers(0, 50, 30), 1, classes=7)
    network.table[:] = random.normal(0, 0.5, network.table.shape)
    context, target = random.integers(0, 31, (200, 4)).astype(np.int32), random.integers(0, 30, 200).astype(np.int32)
    return network, context, target[np.argsort(network.class_of[target], kind="stable")]


def test_probabilities_equal_plain_loops():
    network, context, target = _small_network()
    inputs, members, tops, sides = (k.astype(float) for k in network.kinds(network.table))
    assert 1 < len(tops) < 30 and (np.diff(network.edges) > 1).any()
    got = network.log_probabilities(context, target)
    for i in range(len(target)):
        h = np.tanh([sum(inputs[context[i, k], d] * sides[k, d] for k in range(4)) for d in range(lm_score.HIDDEN)])
        level = np.exp(tops[:, :-1] @ h + tops[:, -1])
        p = []
        for c in range(len(tops)):
            own = members[network.edges[c] : network.edges[c + 1]]
            inner = np.exp(own[:, :-1] @ h + own[:, -1])
            p += list(level[c] / level.sum() * inner / inner.sum())
        assert abs(sum(p) - 1) < 1e-9 and abs(np.log(p[target[i]]) - got[i]) < 1e-4


def test_gradient_equals_differences():
    network, context, target = _small_network()
    network.table = network.table.astype(np.float64)
    whole = np.zeros(network.table.shape)
    for rows, step in network.gradient(context, target):
        whole[rows] += step
    random = np.random.default_rng(8)
    for kind in range(4):
        for row in random.integers(network.starts[kind], network.starts[kind + 1], 6):
            for column in (0, 7, lm_score.HIDDEN):
                values = []
                for move in (1e-4, -1e-4):
                    near = network.copy()
                    near.table[row, column] += move
                    values.append(-near.log_probabilities(context, target).sum())
                assert abs((values[0] - values[1]) / 2e-4 - whole[row, column]) < 1e-3


def test_held_out_texts_are_likelier_than_under_counts(docs):
    texts = lm_score.encoded_texts(docs.where("doc_id % 4 != 0"))
    other = lm_score.encoded_texts(docs.where("doc_id % 4 = 0"))
    fresh = lm_score.fresh_network(lm_score.bucket_counts(texts), 3)

    def mean(network):
        rows = lm_score.scores(other, network).toPandas()
        return rows["log_prob"].sum() / rows["n_tokens"].sum()

    assert mean(lm_score.trained(texts)) > mean(fresh) + 0.2


@pytest.mark.parametrize("block_words", [None, 4096])
def test_tiny_sources_get_their_target(spark, block_words):
    rows = [(k, " ".join(["w"] * (1 + k % 60)), f"tiny{k}") for k in range(200)]
    rows += [(1000 + k, " ".join(["w"] * 500), "hot") for k in range(400)]
    rows += [(2000, " ".join(["w"] * 900), "small")]
    made = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=block_words)
    got = defaultdict(int)
    for r in made.taken.collect():
        assert r.taken <= 2 * r["size"]
        got[r.source, r.target] += r.taken
    assert len(got) == 202
    assert all(abs(n - target) <= max(0.5, 0.02 * target) for (_, target), n in got.items())
    slots = made.slots.collect()
    assert len({(r.source_no, r.rank) for r in slots}) == len(slots)
    ends = max(r.slot for r in slots)
    assert sum(r.slot <= ends // 2 for r in slots) == pytest.approx(len(slots) / 2, rel=0.03)


def test_pipeline_stages_act(spark, docs):
    left = docs
    for (name, stage), least in zip(corpus_pipeline.STAGES[:4], (150, 100, 90, 90)):
        out = stage(spark, left, FOLDER).cache()
        assert out.columns == docs.columns and out.count() >= least
        if name == "near_duplicates":
            groups = {r.doc_id for r in near_dedup.near_groups(left).where("kept").collect()}
            assert sorted(r.doc_id for r in out.collect()) == sorted(groups)
        left = out
    assert left.count() > left.distinct().count()
    rows = corpus_pipeline.STAGES[4][1](spark, left, FOLDER)
    assert rows.select("sequence_id").distinct().count() > 1
