"""The registered queries of the operators and, where SQL can say it, their checks."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.cluster import tune
from sessionloom.llm import (
    centroids,
    fingerprints,
    langid,
    licenses,
    lm_score,
    mixing,
    near_dedup,
    packing,
    quality,
    shards,
    token_counts,
    token_files,
    whitening,
)

BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/documents.parquet")


def op1_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, folder))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), WORD_TOKENIZER, END_ID)


def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, folder))


def op4_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.pseudo_likelihood(documents(spark, folder))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    taken = mixing.mix(documents(spark, folder)).taken
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(documents(spark, folder), BYTE_TOKENIZER)


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_rules(documents(spark, folder).select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(documents(spark, folder))


def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.read_token_files(
        token_files.write_token_files(documents(spark, folder), BYTE_TOKENIZER, END_ID)
    )


def op10_section_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.section_token_counts(documents(spark, folder), BYTE_TOKENIZER)


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(tune(spark).read.parquet(f"{folder}/embeddings.parquet"))


def op12_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shards.document_slots(documents(spark, folder))


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    vectors = tune(spark).read.parquet(f"{folder}/embeddings.parquet")
    return centroids.clusters_with_inertia(centroids.cluster_vectors(vectors))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    top = str(Path(__file__).resolve().parents[2])
    if top not in sys.path:
        sys.path.insert(0, top)
    import corpus_pipeline

    return corpus_pipeline.run(tune(spark), folder)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_near_duplicates, op2_packing, op3_fingerprints, op4_lm_scores, op5_mixing, op6_language,
        op7_quality, op8_licenses, op9_token_files, op10_section_tokens, op11_whitening, op12_sharding, op13_centroids,
        pipeline,
    )
}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

NEAR_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS reached FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached),
m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""

MIX_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len({WORDS}) AS size,
    md5(concat('7:', coalesce(CAST(doc_id AS VARCHAR), '-'), ':', md5(coalesce(text, '')))) AS k FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM s0),
s2 AS (SELECT *, ([5.0, 2.0, 1.0])[no % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s1),
s3 AS (SELECT *, cap / weight AS ratio FROM s2),
s4 AS (SELECT *,
  coalesce(sum(cap) OVER (ORDER BY ratio, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
  sum(weight) OVER (ORDER BY ratio, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
  sum(source_size) OVER () AS total FROM s3),
s5 AS (SELECT *, (1.5::DOUBLE * total - caps) / rest AS level FROM s4),
lv AS (SELECT level FROM s5 WHERE level <= ratio ORDER BY ratio, no LIMIT 1),
s6 AS (SELECT source, no, source_size, least(cap, coalesce((SELECT level FROM lv) * weight, cap)) AS target FROM s5),
bw AS (SELECT least(4096, greatest(8, floor(sum(target) / 500000))) AS words FROM s6),
s7 AS (SELECT *, CAST(greatest(1, round(source_size / (SELECT words FROM bw))) AS BIGINT) AS blocks FROM s6),
s8 AS (SELECT *, coalesce(target * blocks / nullif(source_size, 0), 0) AS slots FROM s7),
s9 AS (SELECT *, CAST(round(sum(slots) OVER (ORDER BY no) / sum(slots) OVER () * 2147483648) AS BIGINT) AS hi FROM s8),
s AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY no), 0) AS lo FROM s9),
p AS (SELECT i, ((i % 2147483648) * 1327217885) % 2147483648 AS point
  FROM range(0, (SELECT CAST(ceil(sum(slots)) AS BIGINT) FROM s8)) t(i)),
q AS (SELECT no, blocks, row_number() OVER (PARTITION BY no ORDER BY i) - 1 AS rank
  FROM p JOIN s ON point >= lo AND point < hi),
u AS (SELECT no, rank % blocks AS block, count(*) AS uses FROM q WHERE rank < 2 * blocks GROUP BY ALL),
e AS (SELECT doc_id, size, s.no, s.source_size, s.target, s.blocks, k,
  CAST(coalesce(sum(size) OVER (PARTITION BY s.no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS BIGINT) AS start FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
f AS (SELECT *, unnest(range(start * blocks // source_size, ((start + size) * blocks - 1) // source_size + 1)) AS block
  FROM e WHERE size > 0),
g AS (SELECT no, start, sum(uses * greatest(0, least(((block + 1) * source_size + blocks - 1) // blocks, start + size)
    - greatest((block * source_size + blocks - 1) // blocks, start))) AS taken
  FROM f JOIN u USING (no, block) GROUP BY ALL)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0 THEN coalesce(taken, 0) ELSE 0 END AS BIGINT) AS taken
FROM e LEFT JOIN g USING (no, start)
"""

QUALITY_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8),
x AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM i),
t AS (SELECT doc_id, g FROM x GROUP BY ALL HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT x.doc_id, unnest(range(x.i, x.i + 8)) AS p FROM x JOIN t USING (doc_id, g)) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS lines,
    len(regexp_extract_all(text, '[A-Z]')) AS upper,
    coalesce(c.n, 0) AS n_repeat_words,
    len(list_intersect(ws, {sorted(set(quality.STOP_WORDS))})) AS stops
  FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 2 * n_words AND 25 * n_words AND n_symbols / n_words <= 0.1
  AND upper / word_chars <= 0.5 AND stops >= 1 AND n_dup_lines / len(lines) <= 0.5 AS kept
FROM b
"""



def centroid_sql(k: int = centroids.CENTROIDS, rounds: int = centroids.ROUNDS) -> str:
    """Every round as a common table expression; rows are numbered, as ids can repeat."""

    def nearest(centres: str) -> str:
        return f"""SELECT x.r, any_value(x.vec_id) AS vec_id, any_value(x.x) AS x,
    min(struct_pack(d := list_sum(list_transform(list_zip(x.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT,
      c := c.no)) AS best FROM x, {centres} c GROUP BY x.r"""

    steps = []
    for i in range(rounds):
        steps.append(f"""
a{i} AS MATERIALIZED ({nearest(f"c{i}")}),
s{i} AS (SELECT best.c AS no, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, 65) t(i) GROUP BY ALL),
m{i} AS (SELECT no, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{i} GROUP BY no),
c{i + 1} AS MATERIALIZED (SELECT no, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (no))""")
    return f"""
WITH x AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: isfinite(c))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS no, x FROM (
  SELECT sha256('{centroids.SEED}:' || vec_id) AS h, x FROM x ORDER BY h NULLS LAST, x LIMIT {k})),{",".join(steps)},
f AS ({nearest(f"c{rounds}")}),
g AS (SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance FROM f)
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM g JOIN c{rounds} c ON c.no = cluster
"""


CHECKS = {
    "op1_near_duplicates": NEAR_SQL,
    "op5_mixing": MIX_SQL,
    "op7_quality": QUALITY_SQL,
    "op13_centroids": centroid_sql(),
}
