"""Time expressions: parsing, calendar fields, day parts, durations and birth years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.fixed_values import BIRTH_YEARS, DAY_PARTS

def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def parse_time(value: Column | str, fmt: str | None = None) -> Column:
    """Text to timestamp; text that is no timestamp becomes null."""
    column = as_column(value)
    if fmt is None:
        return column.try_cast("timestamp_ntz")
    return F.try_to_timestamp(column, F.lit(fmt)).cast("timestamp_ntz")


def micros(value: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone.

    (``timestampdiff`` would go through the session time zone and its clock changes.)
    """
    column = as_column(value)
    seconds = F.extract(F.lit("SECOND"), column)  # decimal(8, 6)
    of_day = (F.hour(column) * 3600 + F.minute(column) * 60).cast("bigint") * 1_000_000
    days = F.unix_date(F.to_date(column)).cast("bigint")
    return days * 86_400_000_000 + of_day + (seconds * 1_000_000).cast("bigint")


def seconds_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)


def day_part(hour: Column | str, preset: str) -> Column:
    """Day part of an hour; the presets differ in cut points and labels."""
    column = as_column(hour)
    parts, otherwise = DAY_PARTS[preset]
    first, last, label = parts[0]
    result = F.when(column.between(first, last), F.lit(label))
    for first, last, label in parts[1:]:
        result = result.when(column.between(first, last), F.lit(label))
    return result.otherwise(F.lit(otherwise))


def is_weekend(value: Column | str) -> Column:
    return (F.weekday(as_column(value)) >= 5).cast("int")


def time_features(df: DataFrame, ts: str) -> DataFrame:
    """Hour, weekday (Monday = 0), day, month, year, weekend flag and the named day part."""
    return df.withColumns(
        {
            "hour": F.hour(ts),
            "day_of_week": F.weekday(ts),
            "day": F.dayofmonth(ts),
            "month": F.month(ts),
            "year": F.year(ts),
            "is_weekend": is_weekend(ts),
            "time_period": day_part(F.hour(ts), "right_closed"),
        }
    )


def date_parts(df: DataFrame, source: str, fmt: str | None = None) -> DataFrame:
    """Replace a date text by its year, month and day; bad dates give nulls."""
    moment = parse_time(source, fmt)
    return df.withColumns(
        {
            f"{source}_year": F.year(moment),
            f"{source}_month": F.month(moment),
            f"{source}_day": F.dayofmonth(moment),
        }
    ).drop(source)


def parse_year(
    value: Column | str, low: int = BIRTH_YEARS[0], high: int = BIRTH_YEARS[1]
) -> Column:
    """Birth year of a date text: a written 19xx/20xx, else two short date formats.

    Two-digit years from 69 on belong to the 1900s. Years outside ``[low, high]`` give null.
    """
    text = F.trim(as_column(value))
    written = F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1).try_cast("int")
    short = F.when(
        text.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{2}$"), F.try_to_timestamp(text, F.lit("d-MMM-yy"))
    ).when(
        text.rlike(r"^\d{1,2}/\d{1,2}/\d{2} \d{1,2}:\d{2}$"),
        F.try_to_timestamp(text, F.lit("M/d/yy H:mm")),
    )
    short_year = F.year(short)
    year = F.coalesce(
        written, F.when(short_year >= 2069, short_year - 100).otherwise(short_year)
    )
    return F.when(year.between(low, high), year)
