"""The three whole plans: session table, event feature table, survey table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.fixed_values import (
    SURVEY_CODES,
    SURVEY_MISSING,
    SIBLING_NOTES,
    UNIVERSITY_GRADE_EXCEPTIONS,
)
from sessionloom.functions.moments import parse_year, time_features
from sessionloom.functions.texts import (
    long_words,
    money_amount,
    normalize_text,
    range_midpoint,
    word_total,
)
from sessionloom.operators import history, sessions
from sessionloom.operators.encode import narrow_values, one_hot, one_hot_vector
from sessionloom.operators.lookup import code_of, resolve_place
from sessionloom.operators.profile import iqr_filter

NARROW = 1000  # values that become columns

__all__ = ["session_table", "clean_sessions", "event_table", "survey_table"]


def session_table(events: DataFrame, main_categories: list | None = None) -> DataFrame:
    """One row per session with everything a session regressor is fitted on.

    Side tables are fitted on rows of the ``train`` split. The main category becomes a 0/1 column per
    value, given or collected from a narrow category column; a wide one becomes the sparse vector
    ``main_category_vector``.
    """
    train = events.where(F.col("split") == "train")
    popularity = history.category_popularity(train)
    table = sessions.rich_features(
        events,
        history.user_history(train),
        history.inferred_prices(train),
        popularity,
        history.label_mean(train),
    )
    mean_popularity = popularity.agg(F.avg("category_popularity")).scalar()
    table = sessions.behavior_features(table)
    table = sessions.density_features(table, mean_popularity)
    table = sessions.value_segments(table)
    if main_categories is None:
        main_categories = narrow_values(events, "category_id", NARROW)
    if main_categories is None:
        known = events.select(F.col("category_id").alias("main_category"))
        return one_hot_vector(table, "main_category", "main_category_vector", known).drop("main_category")
    return one_hot(table, "main_category", main_categories, "cat")


def clean_sessions(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labelled sessions without outliers, sessions to predict)."""
    labelled = table.where(F.col("session_value").isNotNull())
    unlabelled = table.where(F.col("session_value").isNull()).drop("session_value")
    return iqr_filter(labelled, "session_value"), unlabelled


def event_table(events: DataFrame) -> DataFrame:
    """Event rows with time, user, product, category and session features, gaps filled.

    Numbers are filled with their mean (the label never is), texts with the unknown word. Keys are
    left as they are.
    """
    table = history.with_group_counts(time_features(events, "event_time"))
    means = table.agg(
        F.struct(
            *[F.avg(c).alias(c) for c in ("product_avg_session_value", "category_avg_session_value")]
        )
    ).scalar()
    return table.withColumns(
        {
            c: F.coalesce(F.col(c), means.getField(c))
            for c in ("product_avg_session_value", "category_avg_session_value")
        }
        | {"event_type": normalize_text("event_type", collapse=True)}
    )


PLACES = ["Dogum Yeri", "Ikametgah Sehri", "Lise Sehir"]
BIRTH_DATE = "Dogum Tarihi"
GRADES = {
    "Universite Not Ortalamasi": UNIVERSITY_GRADE_EXCEPTIONS,
    "Lise Mezuniyet Notu": {},
}
AMOUNT = "Baska Kurumdan Aldigi Burs Miktari"
SIBLINGS = "Kardes Sayisi"
PERCENT = "Burslu ise Burs Yuzdesi"
FREE_TEXT = "Girisimcilikle Ilgili Deneyiminizi Aciklayabilir misiniz"


def survey_table(
    survey: DataFrame, sheet: DataFrame | None = None, corrections: DataFrame | None = None
) -> DataFrame:
    """A survey table with its places resolved and its answers turned into numbers.

    Works on the columns that are there. A place column ``X`` gives ``X2``.
    """
    table = survey
    for column in PLACES if sheet is not None else []:
        if column in survey.columns:
            table = resolve_place(table, column, sheet, f"{column}2", corrections)
    changed = {}
    for column, (lower, codes, default) in SURVEY_CODES.items():
        if column in survey.columns:
            answer = F.lower(F.col(column)) if lower else F.col(column)
            code = code_of(answer, codes, default)
            missing = SURVEY_MISSING.get(column)
            if missing is not None:
                code = F.when(F.col(column).isNull(), F.lit(missing)).otherwise(code)
            changed[column] = code
    for column, exceptions in GRADES.items():
        if column in survey.columns:
            changed[column] = range_midpoint(column, exceptions)
    if AMOUNT in survey.columns:
        changed[AMOUNT] = money_amount(F.coalesce(F.col(AMOUNT), F.lit("")))
    if SIBLINGS in survey.columns:
        number = F.col(SIBLINGS).try_cast("double").try_cast("int")
        noted = code_of(F.col(SIBLINGS).cast("string"), SIBLING_NOTES)
        changed[SIBLINGS] = F.when(F.col(SIBLINGS).isNull(), F.lit(0)).otherwise(
            F.coalesce(noted, number)
        )
    if PERCENT in survey.columns:
        changed[PERCENT] = F.coalesce(F.col(PERCENT).try_cast("double"), F.lit(0.0))
    if BIRTH_DATE in survey.columns:
        changed["dogum_clean"] = parse_year(BIRTH_DATE)
    if FREE_TEXT in survey.columns:
        plain = normalize_text(FREE_TEXT)
        changed[f"{FREE_TEXT}2count"] = word_total(plain, legacy=True)
        for i in range(5, 11):
            changed[f"{FREE_TEXT}2count{i}"] = long_words(plain, i, legacy=True)
    return table.withColumns(changed)
