"""The whole plans as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.cluster import fresh_path, spread
from sessionloom.functions.fixed_values import UNKNOWN_WORD
from sessionloom.plans import session_queries as sq
from sessionloom.plans import text_queries as tq
from sessionloom.plans import whole
from sessionloom.plans.common import rounded, sql_rounded
from sessionloom.plans.registry import query
from sessionloom.sources.files import stage
from sessionloom.sources.fixtures import EVENTS_SQL, staged_events, table

CATEGORIES = [f"CAT_{i}" for i in range(10)]
TABLE_NUMBERS = [*sq.RICH_NUMBERS, *sq.BEHAVIOR_RATIOS, *sq.DENSITIES]
SEGMENTS = ["segment_low", "segment_medium", "segment_high"]
DENSITY_SQL = """
  total_events / (session_duration_seconds / 60 + 1) AS events_per_minute,
  total_events / CASE WHEN session_duration_seconds = 0 THEN 1 ELSE session_duration_seconds END
    AS event_density,
  unique_products / CASE WHEN session_duration_seconds = 0 THEN 1
                         ELSE session_duration_seconds END AS prod_per_sec,
  add_to_carts / CASE WHEN views = 0 THEN 1 ELSE views END AS cart_per_view,
  avg_inferred_price / (user_avg_session_value + 1) AS price_sensitivity,
  avg_category_popularity / (SELECT avg(category_popularity) FROM popularity)
    AS category_preference_strength"""


@query(
    "session_model_table",
    EVENTS_SQL
    + sq.RICH_SQL
    + f""",
whole AS (SELECT *, {sq.BEHAVIOR_SQL}, {sq.SMOOTH_SQL}, {DENSITY_SQL}, {sq.SEGMENT_SQL}),
q AS (SELECT quantile_cont(session_value, 0.25) AS q1, quantile_cont(session_value, 0.75) AS q3
      FROM whole)
SELECT user_session, {", ".join(sq.RICH_COUNTS)}, {", ".join(sq.BEHAVIOR_FLAGS)},
  {sql_rounded(TABLE_NUMBERS)}, CAST(seg = 1 AS INTEGER) AS segment_low,
  CAST(seg = 2 AS INTEGER) AS segment_medium, CAST(seg = 3 AS INTEGER) AS segment_high,
  {", ".join(f"CAST(main_category = '{c}' AS INTEGER) AS {c.lower()}" for c in CATEGORIES)}
FROM whole JOIN main USING (user_session), q
WHERE session_value IS NULL
   OR session_value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""",
)
def session_model_table(spark, folder):
    events = staged_events(spark, folder)
    # The quantiles read the labels of the table again, so the table is written first.
    sessions = stage(whole.session_table(events, CATEGORIES), fresh_path(spark, "sessions"))
    labelled, unlabelled = whole.clean_sessions(sessions)
    result = labelled.unionByName(unlabelled, allowMissingColumns=True)
    return rounded(
        result.select(
            sq.KEY, *sq.RICH_COUNTS, *sq.BEHAVIOR_FLAGS, *TABLE_NUMBERS, *SEGMENTS,
            *[F.col(f"cat_{c}").alias(c.lower()) for c in CATEGORIES],
        )
    )


FILLED = ["product_avg_session_value", "category_avg_session_value"]


@query(
    "event_feature_table",
    EVENTS_SQL
    + sq.GROUPS_SQL
    + f""",
t AS (SELECT * FROM ev LEFT JOIN u USING (user_id) LEFT JOIN p USING (product_id)
      LEFT JOIN c USING (category_id) LEFT JOIN s USING (user_session)),
f AS (SELECT * EXCLUDE ({", ".join(FILLED)}),
  {", ".join(f"coalesce({c}, (SELECT avg({c}) FROM t)) AS {c}" for c in FILLED)} FROM t)
SELECT event_id, user_session, round(session_value + 3e-9, 6) AS session_value, split, {tq.collapsed_sql("event_type")} AS event_type,
  CAST(hour(event_time) AS INTEGER) AS hour, CAST(isodow(event_time) - 1 AS INTEGER) AS day_of_week,
  CAST(day(event_time) AS INTEGER) AS day, CAST(month(event_time) AS INTEGER) AS month,
  CAST(isodow(event_time) >= 6 AS INTEGER) AS is_weekend,
  {sq.DAY_PART_SQL["right_closed"].replace("h <=", "hour(event_time) <=")} AS time_period,
  {", ".join(sq.GROUP_COLUMNS)}, {sql_rounded(sq.GROUP_NUMBERS)}
FROM f""",
)
def event_feature_table(spark, folder):
    result = whole.event_table(staged_events(spark, folder))
    return rounded(
        result.select(
            "event_id", sq.KEY, "session_value", "split", "event_type", "hour", "day_of_week",
            "day", "month", "is_weekend", "time_period", *sq.GROUP_COLUMNS, *sq.GROUP_NUMBERS,
        )
    )


EDUCATION = ["Lise", "Üniversite Mezunu", "yüksek lisans", "-"]
GRADE_TEXTS = ["3.50-3", "2.50 ve altı", "3.00-2.50", "1.80 - 2.49", "Not ortalaması yok", "4.0-3.5"]


def _survey(spark, folder):
    """Customers with the part and document of the same number as a survey table."""
    customers = table(spark, folder, "customer")
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_type", "p_size")
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    key = F.col("c_custkey")
    first, second = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    place = (
        F.when(key % 5 == 0, F.concat(F.upper("p_name"), F.lit("!")))
        .when(key % 5 == 1, F.concat(first, F.lit(" 7")))
        .when(key % 5 == 2, F.lower("p_type"))
        .when(key % 5 == 4, F.concat(F.lit("x"), second))
    )

    def one_of(names):
        return F.try_element_at(
            F.array(*[F.lit(n) for n in names]), (key % len(names) + 1).cast("int")
        )

    return (
        customers.join(parts, key == parts.p_partkey, "left")
        .join(docs, key == docs.doc_id, "left")
        .select(
            key.alias("id"),
            place.alias("Dogum Yeri"),
            F.when(F.col("c_mktsegment") == "BUILDING", "Özel")
            .when(F.col("c_mktsegment") == "MACHINERY", "DEVLET")
            .alias("Universite Turu"),
            F.when(F.col("c_acctbal") > 5000, "Evet")
            .when(F.col("c_acctbal") > 0, "hayır")
            .alias("Burs Aliyor mu"),
            one_of(EDUCATION).alias("Baba Egitim Durumu"),
            one_of(GRADE_TEXTS).alias("Universite Not Ortalamasi"),
            F.concat(F.col("p_size").cast("string"), F.lit(" TL")).alias(whole.AMOUNT),
            F.when(key % 3 > 0, (key % 7).cast("string")).alias("Kardes Sayisi"),
            F.concat(F.lit("doğum "), (1985 + key % 30).cast("string")).alias("Dogum Tarihi"),
            F.col("text").alias(whole.FREE_TEXT),
        )
    )


SURVEY_SQL = f"""
WITH c AS (
  SELECT c_custkey AS id, *, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS second
  FROM customer LEFT JOIN part ON p_partkey = c_custkey LEFT JOIN documents ON doc_id = c_custkey),
pw AS (SELECT *, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS second FROM part),
sheet AS (SELECT second AS city, first AS district, p_partkey AS ord FROM pw WHERE p_partkey % 2 = 0),
cities AS (SELECT city, min(ord) AS ord FROM sheet GROUP BY city),
districts AS (SELECT district, arg_max(city, ord) AS city FROM sheet GROUP BY district),
places AS (SELECT id, {tq.normalized_sql(f'''coalesce(CASE id % 5 WHEN 0 THEN upper(p_name) || '!'
  WHEN 1 THEN first || ' 7' WHEN 2 THEN lower(p_type) WHEN 4 THEN 'x' || second END,
  '{UNKNOWN_WORD}')''')} AS place FROM c),
s1 AS (SELECT *, coalesce((SELECT arg_min(city, ord) FROM cities WHERE contains(place, city)), place)
         AS c1 FROM places),
s2 AS (SELECT s1.id, coalesce(districts.city, c1) AS c2 FROM s1 LEFT JOIN districts ON district = c1),
plain AS (SELECT id, {tq.words_sql(f"coalesce({tq.normalized_sql('text')}, '{UNKNOWN_WORD}')")} AS w
          FROM c)
SELECT id, CASE WHEN c2 IN (SELECT city FROM cities) THEN c2 ELSE '{UNKNOWN_WORD}' END AS place,
  CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 0 ELSE -1 END AS school,
  CASE WHEN c_acctbal > 5000 THEN 1 WHEN c_acctbal > 0 THEN 0 ELSE -1 END AS scholarship,
  [3, 4, 5, 0][id % 4 + 1] AS father,
  [3.25, 2.75, 3.0, 2.25, -1.0, 3.75][id % 6 + 1]::DOUBLE AS grade,
  coalesce(p_size, 0)::DOUBLE AS amount,
  CASE WHEN id % 3 > 0 THEN CAST(id % 7 AS INTEGER) ELSE 0 END AS siblings,
  CASE WHEN 1985 + id % 30 BETWEEN 1990 AND 2005 THEN CAST(1985 + id % 30 AS INTEGER) END
    AS birth_year,
  CAST(len(w) AS INTEGER) AS n_words,
  {", ".join(f"CAST(len(list_filter(w, lambda x: length(x) > {i})) AS INTEGER) AS longer_{i}" for i in range(5, 11))}
FROM c JOIN s2 USING (id) JOIN plain USING (id)"""


@query("survey_feature_table", SURVEY_SQL)
def survey_feature_table(spark, folder):
    parts = table(spark, folder, "part")
    sheet = parts.where("p_partkey % 2 = 0").select(
        F.split("p_name", " ")[1].alias("city"),
        F.split("p_name", " ")[0].alias("district"),
        F.col("p_partkey").alias("ord"),
    )
    result = whole.survey_table(_survey(spark, folder), sheet)
    longer = [
        F.col(f"{whole.FREE_TEXT}2count{i}").alias(f"longer_{i}") for i in range(5, 11)
    ]
    return result.select(
        "id",
        F.col("Dogum Yeri2").alias("place"),
        F.col("Universite Turu").alias("school"),
        F.col("Burs Aliyor mu").alias("scholarship"),
        F.col("Baba Egitim Durumu").alias("father"),
        F.col("Universite Not Ortalamasi").alias("grade"),
        F.col(whole.AMOUNT).alias("amount"),
        F.col("Kardes Sayisi").alias("siblings"),
        F.col("dogum_clean").alias("birth_year"),
        F.col(f"{whole.FREE_TEXT}2count").alias("n_words"),
        *longer,
    )
