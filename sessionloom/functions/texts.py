"""Text expressions: id parts, normalisation, words, indicators and numbers written in text."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.fixed_values import (
    AMOUNT_EXCEPTIONS,
    FOLD_CYRILLIC,
    FOLD_GREEK,
    FOLD_SPECIAL,
    UNKNOWN_WORD,
)
from sessionloom.functions.moments import as_column

NUMBER = r"(\d+(?:[.,]\d+)?)"


def id_suffix(value: Column | str) -> Column:
    """The part after the first underscore of an id."""
    return F.try_element_at(F.split(as_column(value), "_"), F.lit(2))


def id_number(value: Column | str) -> Column:
    """The first run of digits of an id, as a number."""
    return F.regexp_extract(as_column(value), r"(\d+)", 1).try_cast("bigint")


@lru_cache(maxsize=1)
def fold_pairs() -> tuple[dict[str, str], dict[str, str]]:
    """Lower-case Latin, Greek and Cyrillic letters to ASCII: (one letter to one, one letter to several
    or none).

    Letters that Unicode decomposes into a base letter and marks follow from that rule.
    """
    single: dict[str, str] = {}
    several: dict[str, str] = {}
    for code in [*range(0x00E0, 0x0250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base = "".join(
            c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c)
        )
        if letter.islower() and base.isascii() and len(base) == 1:
            single[letter] = base
    other = {**FOLD_GREEK, **FOLD_CYRILLIC}
    for code in [*range(0x0370, 0x0400), *range(0x1F00, 0x2000)]:
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)[0]
        if letter.islower() and base in FOLD_GREEK:
            other[letter] = FOLD_GREEK[base]
    for letter, plain in {**other, **FOLD_SPECIAL}.items():
        (single if len(plain) == 1 else several)[letter] = plain
    return single, several


def ascii_fold(value: Column | str) -> Column:
    """Lower-case text to its ASCII spelling; marks on their own are dropped later on."""
    single, several = fold_pairs()
    plain = as_column(value)
    column = F.translate(plain, "".join(single), "".join(single.values()))
    for letter, spelling in several.items():
        column = F.replace(column, F.lit(letter), F.lit(spelling))
    # Most texts hold ASCII only, which is seen from their lengths.
    return F.when(F.octet_length(plain) == F.char_length(plain), plain).otherwise(column)


def normalize_text(value: Column | str, collapse: bool = False) -> Column:
    """Lower case, ASCII spelling, letters and white space only.

    With ``collapse``, runs of white space become one space, the ends are trimmed and a missing
    or empty text becomes the word for "unknown".
    """
    plain = F.regexp_replace(ascii_fold(F.lower(as_column(value))), r"[^a-z\s]+", "")
    if not collapse:
        return plain
    trimmed = F.trim(F.regexp_replace(plain, r"\s+", " "))
    return F.coalesce(F.nullif(trimmed, F.lit("")), F.lit(UNKNOWN_WORD))


def words(value: Column | str) -> Column:
    """Array of the words between white space."""
    return F.filter(F.split(as_column(value), r"\s+"), lambda w: w != "")


def word_total(value: Column | str, legacy: bool = False) -> Column:
    """Number of words; a missing text has none, or one with ``legacy`` (the unknown word)."""
    return F.coalesce(F.size(words(value)), F.lit(1 if legacy else 0))


def long_words(value: Column | str, longer_than: int, legacy: bool = False) -> Column:
    """Number of words longer than ``longer_than`` characters."""
    missing = int(legacy and len(UNKNOWN_WORD) > longer_than)
    return F.coalesce(
        F.size(F.filter(words(value), lambda w: F.length(w) > longer_than)), F.lit(missing)
    )


def word_counts(df: DataFrame, column: str) -> DataFrame:
    """How often each word of a text column occurs."""
    return df.select(F.explode(words(column)).alias("word")).groupBy("word").agg(
        F.count("*").alias("n")
    )


def keyword_flags(df: DataFrame, column: str, keywords: list[str], suffix: str = "") -> DataFrame:
    """One 0/1 column per keyword: does the text contain it, in any case?"""
    lowered = F.lower(F.coalesce(F.col(column), F.lit("")))
    return df.withColumns(
        {
            f"{word}{suffix}": lowered.contains(F.lit(word.lower())).cast("int")
            for word in keywords
        }
    )


def matches_any(value: Column | str, pattern: str) -> Column:
    """0/1: does the text match the alternation, in any case?"""
    return F.coalesce(as_column(value).rlike(f"(?i){pattern}"), F.lit(False)).cast("int")


def _numbers(value: Column) -> Column:
    """All numbers written in a text, a comma or a point before decimals."""
    return F.transform(
        F.regexp_extract_all(value, F.lit(NUMBER), F.lit(1)),
        lambda n: F.replace(n, F.lit(","), F.lit(".")).cast("double"),
    )


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda total, n: total + n)


def _exceptions_first(value: Column, exceptions: dict[str, float], rule: Column) -> Column:
    result = rule
    if exceptions:
        pairs = [F.lit(v) for text, number in exceptions.items() for v in (text, float(number))]
        result = F.coalesce(F.try_element_at(F.create_map(*pairs), value), rule)
    return result


def range_midpoint(
    value: Column | str, exceptions: dict[str, float] | None = None, default: float = -1.0
) -> Column:
    """Middle of a range such as ``84-70``; a text without numbers gives ``default``."""
    column = as_column(value)
    numbers = _numbers(column)
    middle = F.when(F.size(numbers) > 0, _total(numbers) / F.size(numbers))
    return F.coalesce(_exceptions_first(column, exceptions or {}, middle), F.lit(default))


def money_amount(
    value: Column | str, exceptions: dict[str, float] | None = None
) -> Column:
    """Amount meant by a free text: amounts add up, a bare range counts by its middle."""
    column = as_column(value)
    numbers = _numbers(column)
    bare_range = column.rlike(r"^\s*\d+\s*-\s*\d+\s*$")
    amount = F.when(bare_range, _total(numbers) / 2).otherwise(_total(numbers))
    table = AMOUNT_EXCEPTIONS if exceptions is None else exceptions
    return F.coalesce(_exceptions_first(column, table, amount), F.lit(0.0))
