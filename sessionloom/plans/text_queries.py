"""Queries on text: normalisation, words, lookups, parsing, similarity, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.cluster import fresh_path, spread
from sessionloom.functions import texts
from sessionloom.functions.fixed_values import (
    AMOUNT_EXCEPTIONS,
    UNIVERSITY_GRADE_EXCEPTIONS,
    UNKNOWN_WORD,
)
from sessionloom.functions.moments import date_parts, parse_year
from sessionloom.operators import lookup, textsim
from sessionloom.plans.common import rounded
from sessionloom.plans.registry import query
from sessionloom.sources import files
from sessionloom.sources.fixtures import EVENTS_SQL, session_events, table


def fold_sql(expression: str) -> str:
    """The ASCII folding of ``functions.texts`` for the SQL checks."""
    single, several = texts.fold_pairs()
    folded = f"translate({expression}, '{''.join(single)}', '{''.join(single.values())}')"
    for letter, plain in several.items():
        folded = f"replace({folded}, '{letter}', '{plain}')"
    return folded


def normalized_sql(expression: str) -> str:
    return f"regexp_replace({fold_sql(f'lower({expression})')}, '[^a-z\\s]', '', 'g')"


def collapsed_sql(expression: str) -> str:
    one_space = f"trim(regexp_replace({normalized_sql(expression)}, '\\s+', ' ', 'g'))"
    return f"coalesce(nullif({one_space}, ''), '{UNKNOWN_WORD}')"


def words_sql(expression: str) -> str:
    return f"list_filter(string_split_regex({expression}, '\\s+'), lambda w: w <> '')"


def _documents(spark, folder):
    return spread(table(spark, folder, "documents").select("doc_id", "text"))


@query("text_normalize_a", f"SELECT doc_id, {normalized_sql('text')} AS plain FROM documents")
def text_normalize_a(spark, folder):
    docs = _documents(spark, folder)
    return docs.select("doc_id", texts.normalize_text("text").alias("plain"))


@query("text_normalize_b", f"SELECT doc_id, {collapsed_sql('text')} AS plain FROM documents")
def text_normalize_b(spark, folder):
    docs = _documents(spark, folder)
    return docs.select("doc_id", texts.normalize_text("text", collapse=True).alias("plain"))


LATIN_LETTERS, CYRILLIC_LETTERS = "abvgdeziklmnoprstufy", "абвгдезиклмнопрстуфы"
GREEK_LETTERS = {"a": "ά", "b": "β", "g": "γ", "d": "δ", "e": "ή", "i": "ΐ", "l": "Λ", "o": "ώ", "s": "ς", "u": "ϋ"}


@query(
    "text_normalize_scripts",
    f"""
SELECT p_partkey, script, CASE WHEN script = 'signs' THEN plain || ' shchuzhiia psikhe thphi' ELSE plain END AS plain
FROM (SELECT p_partkey, {collapsed_sql('p_name')} AS plain FROM part), (VALUES ('greek'), ('cyrillic'), ('signs')) t(script)""",
)
def text_normalize_scripts(spark, folder):
    """Names respelled in Greek and Cyrillic letters come back in Latin ones."""
    name = F.col("p_name")
    cyrillic = F.translate(F.lower(name), LATIN_LETTERS, CYRILLIC_LETTERS)
    greek = F.translate(F.lower(name), "".join(GREEK_LETTERS), "".join(GREEK_LETTERS.values()))
    forms = [("greek", greek), ("cyrillic", F.upper(cyrillic)), ("signs", F.concat(cyrillic, F.lit(" ЩУЖИЯ Ψιχὴ θφι")))]
    each = F.array(*[F.struct(F.lit(s).alias("script"), form.alias("text")) for s, form in forms])
    rows = table(spark, folder, "part").select("p_partkey", F.inline(each))
    return rows.select("p_partkey", "script", texts.normalize_text("text", collapse=True).alias("plain"))


@query("lower_text", "SELECT doc_id, lower(text) AS lowered FROM documents")
def lower_text(spark, folder):
    return _documents(spark, folder).select("doc_id", F.lower("text").alias("lowered"))


@query(
    "word_counts",
    f"""
SELECT word, count(*) AS n FROM (
  SELECT unnest({words_sql(normalized_sql('text'))}) AS word FROM documents) GROUP BY word""",
)
def word_counts(spark, folder):
    docs = _documents(spark, folder).select(texts.normalize_text("text").alias("plain"))
    return texts.word_counts(docs, "plain")


@query(
    "word_length_counts",
    f"SELECT doc_id, CAST(len({words_sql('text')}) AS INTEGER) AS n_words, "
    + ", ".join(
        f"CAST(len(list_filter({words_sql('text')}, lambda w: length(w) > {i})) AS INTEGER)"
        f" AS longer_than_{i}"
        for i in range(5, 11)
    )
    + " FROM documents",
)
def word_length_counts(spark, folder):
    docs = _documents(spark, folder)
    longer = [texts.long_words("text", i).alias(f"longer_than_{i}") for i in range(5, 11)]
    return docs.select("doc_id", texts.word_total("text").alias("n_words"), *longer)


KEYWORDS = ["the", "que", "und", "license", "email", "tion"]


@query(
    "keyword_flags",
    "SELECT doc_id, "
    + ", ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER) AS {w}_flag" for w in KEYWORDS)
    + " FROM documents",
)
def keyword_flags(spark, folder):
    docs = _documents(spark, folder).select("doc_id", "text")
    return texts.keyword_flags(docs, "text", KEYWORDS, "_flag").drop("text")


@query(
    "keyword_regex",
    "SELECT doc_id, CAST(regexp_matches(text, '(?i)licen[sc]e|copyright|e-?mail') AS INTEGER)"
    " AS legal FROM documents",
)
def keyword_regex(spark, folder):
    docs = _documents(spark, folder)
    legal = texts.matches_any("text", "licen[sc]e|copyright|e-?mail")
    return docs.select("doc_id", legal.alias("legal"))


# --- lookups; the words of part names serve as lists and dictionaries ------------------------


def _part_words(spark, folder):
    words = F.split("p_name", " ")
    return table(spark, folder, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", words[0].alias("first"), words[1].alias("second")
    )


PARTS_SQL = """
WITH pw AS (SELECT *, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS second
            FROM part)"""


@query(
    "first_contained",
    PARTS_SQL
    + """,
items AS (SELECT word, min(o) AS ord FROM (
            SELECT second AS word, p_partkey * 2 + 1 AS o FROM pw WHERE p_partkey % 3 = 0
            UNION ALL SELECT substr(first, 1, 3), p_partkey * 2 FROM pw WHERE p_partkey % 3 = 1)
          GROUP BY word)
SELECT p_partkey, coalesce(
  (SELECT arg_min(word, ord) FROM items WHERE contains(p_name, word)), p_name) AS found
FROM pw""",
)
def first_contained(spark, folder):
    parts = _part_words(spark, folder)
    items = (
        parts.where("p_partkey % 3 = 0")
        .select(F.col("second").alias("word"), (F.col("p_partkey") * 2 + 1).alias("o"))
        .unionByName(
            parts.where("p_partkey % 3 = 1").select(
                F.substring("first", 1, 3).alias("word"), (F.col("p_partkey") * 2).alias("o")
            )
        )
        .groupBy("word")
        .agg(F.min("o").alias("ord"))
    )
    found = lookup.first_contained(parts.select("p_partkey", "p_name"), "p_name", items, "found")
    return found.select("p_partkey", "found")


@query(
    "keep_known",
    PARTS_SQL
    + f""",
known AS (SELECT DISTINCT second AS word FROM pw WHERE p_type = 'ECONOMY' AND p_partkey % 7 = 1)
SELECT p_partkey,
  CASE WHEN second IN (SELECT word FROM known) THEN second ELSE '{UNKNOWN_WORD}' END AS equal_one,
  CASE WHEN EXISTS (SELECT 1 FROM known WHERE contains(p_name, word)) THEN p_name
       ELSE '{UNKNOWN_WORD}' END AS containing
FROM pw""",
)
def keep_known(spark, folder):
    parts = _part_words(spark, folder)
    known = parts.where("p_type = 'ECONOMY' AND p_partkey % 7 = 1")
    known = known.select(F.col("second").alias("word")).distinct()
    kept = lookup.keep_known(parts, "second", known, "equal_one")
    kept = lookup.keep_known(kept, "p_name", known, "containing", mode="contains")
    return kept.select("p_partkey", "equal_one", "containing")


BRAND_OF_SQL = """,
dict AS (SELECT first AS word, arg_max(p_brand, p_partkey) AS brand FROM pw
         WHERE first < 'm' GROUP BY first)"""


def _brand_of(parts):
    early = parts.where(F.col("first") < "m")
    return lookup.last_wins(early, "first", "p_brand", "p_partkey")


@query(
    "map_fallback",
    PARTS_SQL
    + BRAND_OF_SQL
    + "SELECT p_partkey, coalesce(brand, first) AS mapped FROM pw LEFT JOIN dict ON first = word",
)
def map_fallback(spark, folder):
    parts = _part_words(spark, folder)
    mapped = lookup.map_values(parts, "first", _brand_of(parts), "mapped", keep_unmapped=True)
    return mapped.select("p_partkey", "mapped")


@query(
    "map_strict",
    PARTS_SQL
    + BRAND_OF_SQL
    + "SELECT p_partkey, brand AS mapped FROM pw LEFT JOIN dict ON first = word",
)
def map_strict(spark, folder):
    parts = _part_words(spark, folder)
    mapped = lookup.map_values(parts, "first", _brand_of(parts), "mapped", keep_unmapped=False)
    return mapped.select("p_partkey", "mapped")


@query(
    "map_chain",
    PARTS_SQL
    + BRAND_OF_SQL
    + """,
alias AS (SELECT p_brand AS brand, min(p_type) AS kind FROM pw WHERE p_brand < 'Brand#2'
          GROUP BY p_brand)
SELECT p_partkey, coalesce(kind, dict.brand) AS mapped
FROM pw LEFT JOIN dict ON first = word LEFT JOIN alias ON alias.brand = dict.brand""",
)
def map_chain(spark, folder):
    parts = _part_words(spark, folder)
    alias = parts.where(F.col("p_brand") < "Brand#2").groupBy("p_brand").agg(F.min("p_type"))
    mapped = lookup.map_values(parts, "first", _brand_of(parts), "mapped", keep_unmapped=False)
    mapped = lookup.map_values(mapped, "mapped", alias, "mapped", keep_unmapped=True)
    return mapped.select("p_partkey", "mapped")


@query(
    "keyword_semi_join",
    f"""
WITH d AS (SELECT unnest({words_sql(normalized_sql('text'))}) AS word FROM documents),
b AS (SELECT DISTINCT unnest({words_sql(normalized_sql('text'))}) AS word FROM benchmark)
SELECT word, count(*) AS n FROM d WHERE word IN (SELECT word FROM b) GROUP BY word""",
)
def keyword_semi_join(spark, folder):
    def counted(name):
        plain = spread(table(spark, folder, name)).select(texts.normalize_text("text").alias("plain"))
        return texts.word_counts(plain, "plain")

    return counted("documents").join(counted("benchmark").select("word"), "word", "left_semi")


PLACE_SQL = """
CASE p_partkey % 5 WHEN 0 THEN upper(p_name) || '!' WHEN 1 THEN first || ' 7'
     WHEN 2 THEN lower(p_type) WHEN 3 THEN NULL ELSE 'x' || second END"""


@query(
    "gazetteer_resolve",
    PARTS_SQL
    + f""",
sheet AS (SELECT second AS city, first AS district, p_partkey AS ord FROM pw
          WHERE p_partkey % 2 = 0),
cities AS (SELECT city, min(ord) AS ord FROM sheet GROUP BY city),
districts AS (SELECT district, arg_max(city, ord) AS city FROM sheet GROUP BY district),
fixes AS (SELECT 'economy' AS wrong, (SELECT min(city) FROM cities) AS fixed),
places AS (SELECT p_partkey,
             {normalized_sql(f"coalesce({PLACE_SQL}, '{UNKNOWN_WORD}')")} AS place FROM pw),
s1 AS (SELECT *, coalesce((SELECT arg_min(city, ord) FROM cities WHERE contains(place, city)),
                          place) AS c1 FROM places),
s2 AS (SELECT s1.*, coalesce(districts.city, c1) AS c2 FROM s1
       LEFT JOIN districts ON district = c1),
s3 AS (SELECT s2.*, coalesce(fixed, c2) AS c3 FROM s2 LEFT JOIN fixes ON wrong = c2)
SELECT p_partkey, CASE WHEN c3 IN (SELECT city FROM cities) THEN c3 ELSE '{UNKNOWN_WORD}' END
  AS resolved FROM s3""",
)
def gazetteer_resolve(spark, folder):
    parts = _part_words(spark, folder)
    sheet = parts.where("p_partkey % 2 = 0").select(
        F.col("second").alias("city"), F.col("first").alias("district"), F.col("p_partkey").alias("ord")
    )
    fixes = sheet.groupBy(F.lit("economy").alias("wrong")).agg(F.min("city").alias("fixed"))
    places = parts.select(
        "p_partkey",
        F.when(F.col("p_partkey") % 5 == 0, F.concat(F.upper("p_name"), F.lit("!")))
        .when(F.col("p_partkey") % 5 == 1, F.concat("first", F.lit(" 7")))
        .when(F.col("p_partkey") % 5 == 2, F.lower("p_type"))
        .when(F.col("p_partkey") % 5 == 4, F.concat(F.lit("x"), "second"))
        .alias("place"),
    )
    resolved = lookup.resolve_place(places, "place", sheet, "resolved", fixes)
    return resolved.select("p_partkey", "resolved")


# --- numbers and dates written as text -------------------------------------------------------

QUANTITY_SQL = "CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)"
PART_SQL = "CAST(l_partkey AS VARCHAR)"
MONEY_TEXT_SQL = f"""
CASE l_linenumber WHEN 1 THEN {QUANTITY_SQL} || ' TL'
  WHEN 2 THEN {PART_SQL} || 'TL, ' || {QUANTITY_SQL} || 'TL'
  WHEN 3 THEN 'Aylık ' || {PART_SQL} || ',50 tl' WHEN 4 THEN {QUANTITY_SQL} || '-' || {PART_SQL}
  WHEN 5 THEN 'burs yok' WHEN 6 THEN 'kredi-300' ELSE {PART_SQL} END"""
NUMBERS_SQL = (
    "list_transform(regexp_extract_all(t, '(\\d+(?:[.,]\\d+)?)', 1),"
    " lambda n: CAST(replace(n, ',', '.') AS DOUBLE))"
)


def _texts_of_lines(spark, folder, *cases):
    """Lines with a text built from their numbers, one form per line number."""
    quantity = F.col("l_quantity").cast("int").cast("string")
    part = F.col("l_partkey").cast("string")
    text = cases[-1](quantity, part)
    for number, case in reversed(list(enumerate(cases[:-1], 1))):
        text = F.when(F.col("l_linenumber") == number, case(quantity, part)).otherwise(text)
    lines = table(spark, folder, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", text.alias("t"))


@query(
    "money_parse",
    f"""
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN t = 'kredi-300' THEN {AMOUNT_EXCEPTIONS['kredi-300']}
    WHEN regexp_matches(t, '^\\s*\\d+\\s*-\\s*\\d+\\s*$') THEN list_sum({NUMBERS_SQL}) / 2
    ELSE coalesce(list_sum({NUMBERS_SQL}), 0) END + 3e-9, 6) AS amount
FROM (SELECT l_orderkey, l_linenumber, l_partkey, {MONEY_TEXT_SQL} AS t FROM lineitem)""",
)
def money_parse(spark, folder):
    lines = _texts_of_lines(
        spark,
        folder,
        lambda q, p: F.concat(q, F.lit(" TL")),
        lambda q, p: F.concat(p, F.lit("TL, "), q, F.lit("TL")),
        lambda q, p: F.concat(F.lit("Aylık "), p, F.lit(",50 tl")),
        lambda q, p: F.concat(q, F.lit("-"), p),
        lambda q, p: F.lit("burs yok"),
        lambda q, p: F.lit("kredi-300"),
        lambda q, p: p,
    )
    return rounded(lines.withColumn("amount", texts.money_amount("t")).drop("t"))


RANGE_TEXT_SQL = f"""
CASE l_linenumber WHEN 1 THEN {QUANTITY_SQL} || '-' || {PART_SQL}
  WHEN 2 THEN {QUANTITY_SQL} || '.50 - ' || {PART_SQL} WHEN 3 THEN '3.00-2.50'
  WHEN 4 THEN '2.50 ve altı' WHEN 5 THEN 'Ortalama bulunmuyor' ELSE {QUANTITY_SQL} END"""


@query(
    "range_midpoint",
    f"""
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE
    WHEN t = '3.00-2.50' THEN {UNIVERSITY_GRADE_EXCEPTIONS['3.00-2.50']}
    WHEN t = '2.50 ve altı' THEN {UNIVERSITY_GRADE_EXCEPTIONS['2.50 ve altı']}
    ELSE coalesce(list_avg({NUMBERS_SQL}), -1) END + 3e-9, 6) AS grade
FROM (SELECT l_orderkey, l_linenumber, l_partkey, {RANGE_TEXT_SQL} AS t FROM lineitem)""",
)
def range_midpoint(spark, folder):
    lines = _texts_of_lines(
        spark,
        folder,
        lambda q, p: F.concat(q, F.lit("-"), p),
        lambda q, p: F.concat(q, F.lit(".50 - "), p),
        lambda q, p: F.lit("3.00-2.50"),
        lambda q, p: F.lit("2.50 ve altı"),
        lambda q, p: F.lit("Ortalama bulunmuyor"),
        lambda q, p: q,
    )
    grade = texts.range_midpoint("t", UNIVERSITY_GRADE_EXCEPTIONS)
    return rounded(lines.withColumn("grade", grade).drop("t"))


@query(
    "birth_year",
    """
SELECT o_orderkey, CASE WHEN y BETWEEN 1990 AND 2005 THEN y END AS birth_year FROM (
  SELECT o_orderkey, CAST(coalesce(
    TRY_CAST(nullif(regexp_extract(t, '\\b((?:19|20)\\d{2})\\b', 1), '') AS INTEGER),
    year(try_strptime(t, ['%d-%b-%y', '%m/%d/%y %H:%M']))) AS INTEGER) AS y
  FROM (SELECT o_orderkey, trim(CASE o_orderkey % 5
          WHEN 0 THEN ' ' || strftime(o_orderdate, '%Y-%m-%d') || ' '
          WHEN 1 THEN strftime(o_orderdate, '%d-%b-%y')
          WHEN 2 THEN strftime(o_orderdate, '%m/%d/%y %H:%M')
          WHEN 3 THEN 'Kasım ' || (year(o_orderdate) - 5)
          ELSE 'on ' || strftime(o_orderdate, '%d.%m') END) AS t FROM orders))""",
)
def birth_year(spark, folder):
    orders = table(spark, folder, "orders")
    date, form = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = (
        F.when(form == 0, F.concat(F.lit(" "), F.date_format(date, "yyyy-MM-dd"), F.lit(" ")))
        .when(form == 1, F.date_format(date, "dd-MMM-yy"))
        .when(form == 2, F.date_format(date, "MM/dd/yy HH:mm"))
        .when(form == 3, F.concat(F.lit("Kasım "), (F.year(date) - 5).cast("string")))
        .otherwise(F.concat(F.lit("on "), F.date_format(date, "dd.MM")))
    )
    return orders.select("o_orderkey", parse_year(text).alias("birth_year"))


@query(
    "date_parts_coerced",
    """
SELECT o_orderkey, CAST(year(d) AS INTEGER) AS written_year, CAST(month(d) AS INTEGER)
         AS written_month, CAST(day(d) AS INTEGER) AS written_day
FROM (SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS d
      FROM orders)""",
)
def date_parts_coerced(spark, folder):
    orders = table(spark, folder, "orders")
    text = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("not a date")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    return date_parts(orders.select("o_orderkey", text.alias("written")), "written")


# --- similarity ------------------------------------------------------------------------------

MAX_TERMS = 1000  # as in the code rebuilt here; the queries ending in _all keep every term


def tfidf_sql(source: str, max_terms: int | str = 1000) -> str:
    """Common table expressions ending in ``weights(id, term, w)`` for ``source(id, text)``."""
    return f"""
WITH docs AS ({source}),
tf AS (SELECT id, term, count(*) AS tf FROM (
         SELECT id, unnest(regexp_extract_all(lower(text), '\\b\\w\\w+\\b')) AS term FROM docs)
       GROUP BY id, term),
terms AS (SELECT term, count(*) AS df FROM tf GROUP BY term
          ORDER BY sum(tf) DESC, term LIMIT {max_terms}),
raw AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM docs)) / (1 + df)) + 1) AS w
        FROM tf JOIN terms USING (term)),
weights AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw)"""


NAMES_SQL = "SELECT DISTINCT p_name AS id, p_name AS text FROM part"
NUMBERED_DOCS_SQL = (
    f"SELECT min(doc_id) AS id, text FROM (SELECT doc_id, {normalized_sql('text')} AS text"
    " FROM documents) GROUP BY text"
)


def _names(spark, folder):
    return table(spark, folder, "part").select("p_name").distinct()


def _plain_docs(spark, folder):
    return _documents(spark, folder).select("doc_id", texts.normalize_text("text").alias("text"))


@query(
    "tfidf_weights",
    tfidf_sql(NAMES_SQL) + "SELECT id, term, round(w + 3e-9, 6) AS w FROM weights",
)
def tfidf_weights(spark, folder):
    return rounded(textsim.tfidf(_names(spark, folder), "p_name", "p_name", MAX_TERMS))


@query(
    "tfidf_documents",
    tfidf_sql(NUMBERED_DOCS_SQL, "ALL") + "SELECT id, term, round(w + 3e-9, 6) AS w FROM weights",
)
def tfidf_documents(spark, folder):
    return rounded(textsim.tfidf(_plain_docs(spark, folder), "doc_id", "text", once=True))


@query(
    "tfidf_documents_all",
    tfidf_sql(NUMBERED_DOCS_SQL, "ALL") + "SELECT id, term, round(w + 3e-9, 6) AS w FROM weights",
)
def tfidf_documents_all(spark, folder):
    return rounded(textsim.tfidf(_plain_docs(spark, folder), "doc_id", "text", once=True))


@query(
    "cosine_pairs",
    tfidf_sql(NAMES_SQL)
    + """
SELECT x.id AS a, y.id AS b, round(sum(x.w * y.w) + 3e-9, 6) AS sim
FROM weights x JOIN weights y ON x.term = y.term AND x.id < y.id
GROUP BY x.id, y.id HAVING sum(x.w * y.w) >= 0.2""",
)
def cosine_pairs(spark, folder):
    vectors = textsim.tfidf_vectors(_names(spark, folder), "p_name", "p_name", MAX_TERMS)
    return rounded(textsim.cosine_pairs(vectors, 0.2))


@query(
    "cosine_pairs_documents",
    tfidf_sql(NUMBERED_DOCS_SQL, "ALL")
    + """
SELECT x.id AS a, y.id AS b, round(sum(x.w * y.w) + 3e-9, 6) AS sim
FROM weights x JOIN weights y ON x.term = y.term AND x.id < y.id
GROUP BY x.id, y.id HAVING sum(x.w * y.w) >= 0.9""",
)
def cosine_pairs_documents(spark, folder):
    vectors = textsim.tfidf_vectors(_plain_docs(spark, folder), "doc_id", "text", once=True, shared=True)
    return rounded(textsim.cosine_pairs(vectors, 0.9))


@query(
    "cosine_pairs_documents_all",
    tfidf_sql(NUMBERED_DOCS_SQL, "ALL")
    + """
SELECT x.id AS a, y.id AS b, round(sum(x.w * y.w) + 3e-9, 6) AS sim
FROM weights x JOIN weights y ON x.term = y.term AND x.id < y.id
GROUP BY x.id, y.id HAVING sum(x.w * y.w) >= 0.9""",
)
def cosine_pairs_documents_all(spark, folder):
    vectors = textsim.tfidf_vectors(_plain_docs(spark, folder), "doc_id", "text", once=True, shared=True)
    return rounded(textsim.cosine_pairs(vectors, 0.9))


@query("text_clusters")
def text_clusters(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_name")
    return textsim.cluster_texts(parts, "p_name", 0.80, "name_cluster", MAX_TERMS)


DOCUMENT_CUT = 0.25


@query("text_clusters_documents")
def text_clusters_documents(spark, folder):
    vectors = textsim.tfidf_vectors(_plain_docs(spark, folder), "doc_id", "text", once=True, shared=True)
    return textsim.linkage_clusters(vectors, DOCUMENT_CUT)


@query(
    "text_clusters_documents_small",
    tfidf_sql(NUMBERED_DOCS_SQL, "ALL")
    + f""",
pairs AS (SELECT x.id AS a, y.id AS b FROM weights x JOIN weights y ON x.term = y.term AND x.id < y.id
  GROUP BY x.id, y.id HAVING round(sum(x.w * y.w), 12) > {1 - DOCUMENT_CUT}),
ends AS (SELECT a AS id, b AS other FROM pairs UNION ALL SELECT b, a FROM pairs),
degree AS (SELECT id, count(*) AS n, min(other) AS other FROM ends GROUP BY id)
SELECT d.id, coalesce(least(d.id, x.other), d.id) AS cluster
FROM (SELECT DISTINCT id FROM weights) d LEFT JOIN degree x ON x.id = d.id LEFT JOIN degree y ON y.id = x.other
WHERE coalesce(x.n, 1) = 1 AND coalesce(y.n, 1) = 1""",
)
def text_clusters_documents_small(spark, folder):
    """The clusters of documents that stand alone or have one partner above the cut."""
    vectors = textsim.tfidf_vectors(_plain_docs(spark, folder), "doc_id", "text", once=True, shared=True)
    sims = files.stage(textsim.similar_pairs(vectors, 1 - DOCUMENT_CUT), fresh_path(spark, "sims"))
    clusters = textsim.clusters_above(vectors, DOCUMENT_CUT, sims)
    pairs = sims.where(F.round("sim", 12) > 1 - DOCUMENT_CUT).select("a", "b")
    return textsim.lone_or_paired(pairs, clusters)


DIMENSIONS = 64


@query(
    "session_embedding_mean",
    EVENTS_SQL
    + "SELECT user_session, "
    + ", ".join(
        f"round(avg(coalesce(embedding[{i + 1}], 0)::DOUBLE) + 3e-9, 6) AS emb_{i}"
        for i in range(DIMENSIONS)
    )
    + " FROM ev LEFT JOIN embeddings ON product_id = 'PROD_' || vec_id GROUP BY user_session",
)
def session_embedding_mean(spark, folder):
    vectors = table(spark, folder, "embeddings").select(
        F.concat(F.lit("PROD_"), F.col("vec_id").cast("string")).alias("product_id"), "embedding"
    )
    events = session_events(spark, folder)
    means = textsim.session_vectors(
        events, vectors, "user_session", "product_id", "embedding", DIMENSIONS
    )
    return rounded(
        means.select("user_session", *[F.col("mean")[i].alias(f"emb_{i}") for i in range(DIMENSIONS)])
    )
