"""Lookups: side tables, dictionaries, containment in a list, place resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.fixed_values import UNKNOWN_WORD
from sessionloom.functions.texts import normalize_text


def attach(
    df: DataFrame, side: DataFrame, key: str | list[str], fills: dict[str, object] | None = None
) -> DataFrame:
    """Left join of a side table with one row per key, missing matches filled.

    No broadcast hint: the side may grow with the data, so AQE decides from its measured size and
    splits hot keys of the big side otherwise. A fill may be a column, e.g. a scalar subquery.
    """
    joined = df.join(side, key, "left")
    fills = {
        name: value if isinstance(value, Column) else F.lit(value)
        for name, value in (fills or {}).items()
    }
    return joined.withColumns({n: F.coalesce(F.col(n), v) for n, v in fills.items()})


def code_of(column: Column | str, table: dict, default: object = None) -> Column:
    """Value of a small fixed dictionary; anything else gives ``default``."""
    source = F.col(column) if isinstance(column, str) else column
    literal = F.create_map(*[F.lit(part) for pair in table.items() for part in pair])
    found = F.try_element_at(literal, source)
    return found if default is None else F.coalesce(found, F.lit(default))


def last_wins(df: DataFrame, key: str, value: str, order: str | list[str]) -> DataFrame:
    """One row per key with the value written last in the given order."""
    at = F.struct(*([order] if isinstance(order, str) else order))
    return df.groupBy(key).agg(F.max_by(value, at).alias(value))


def map_values(
    df: DataFrame, column: str, lookup: DataFrame, to: str, keep_unmapped: bool
) -> DataFrame:
    """Look a column up in a (key, value) table with unique keys.

    Values without an entry stay as they are with ``keep_unmapped``, else become null.
    """
    side = lookup.select(F.col(lookup.columns[0]).alias("_key"), F.col(lookup.columns[1]).alias("_to"))
    joined = df.join(side, F.col(column) == F.col("_key"), "left")
    found = F.coalesce("_to", F.col(column)) if keep_unmapped else F.col("_to")
    return joined.withColumn(to, found).drop("_key", "_to")


def _contained_pairs(values: DataFrame, column: str, items: DataFrame, item: str) -> DataFrame:
    """(value, matching item row) for items occurring inside the value, as an equi join.

    Each value is cut into its substrings of the lengths that items have, so no value is held
    against every item.
    """
    lengths = items.agg(F.collect_set(F.length(item))).scalar()
    text = F.col(column)
    fitting = F.filter("_lengths", lambda n: n <= F.length(text))
    pieces = F.flatten(
        F.transform(
            fitting,
            lambda n: F.transform(
                F.sequence(F.lit(1), F.length(text) - n + 1), lambda at: F.substring(text, at, n)
            ),
        )
    )
    sized = values.withColumn("_lengths", lengths)
    cut = sized.select(text, F.explode(F.array_distinct(pieces)).alias("_piece"))
    return cut.join(items, F.col("_piece") == F.col(item)).drop("_piece")


def first_contained(
    df: DataFrame, column: str, items: DataFrame, to: str, keep_unmatched: bool = True
) -> DataFrame:
    """First entry of an ordered list ``(item, ord)`` that occurs inside the value.

    Distinct values are matched once. Without a match the value stays, or becomes null.
    """
    item, ord_ = items.columns[:2]
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    found = (
        _contained_pairs(values, column, items, item)
        .groupBy(column)
        .agg(F.min_by(item, F.struct(ord_, item)).alias("_found"))
    )
    result = F.coalesce("_found", F.col(column)) if keep_unmatched else F.col("_found")
    return df.join(found, column, "left").withColumn(to, result).drop("_found")


def keep_known(
    df: DataFrame, column: str, items: DataFrame, to: str, mode: str = "equal",
    default: str = UNKNOWN_WORD,
) -> DataFrame:
    """Keep a value that equals (or, with ``contains``, contains) a list item, else ``default``."""
    item = items.columns[0]
    if mode == "equal":
        known = items.select(F.col(item).alias(column)).distinct()
    else:
        values = df.select(column).where(F.col(column).isNotNull()).distinct()
        known = _contained_pairs(values, column, items.select(item).distinct(), item)
        known = known.select(column).distinct()
    joined = df.join(known.withColumn("_known", F.lit(True)), column, "left")
    kept = F.when(F.col("_known"), F.col(column)).otherwise(F.lit(default))
    return joined.withColumn(to, kept).drop("_known")


def resolve_place(
    df: DataFrame, column: str, sheet: DataFrame, to: str, corrections: DataFrame | None = None,
    mode: str = "equal",
) -> DataFrame:
    """City of a free-text place.

    ``sheet`` has ``city, district, ord``. The normalised text gives the first city it contains,
    then districts become their city, then corrections apply, and what is no city is unknown.
    The chain runs on distinct texts and comes back in one join.
    """
    texts = df.select(column).distinct()
    texts = texts.withColumn(
        "_place", normalize_text(F.coalesce(F.col(column), F.lit(UNKNOWN_WORD)))
    )
    sheet = sheet.withColumns({n: normalize_text(n) for n in ("city", "district")})
    cities = sheet.groupBy("city").agg(F.min("ord").alias("ord"))
    places = texts.select("_place").distinct()
    chain = first_contained(places, "_place", cities, "_city")
    chain = map_values(chain, "_city", last_wins(sheet, "district", "city", "ord"), "_city", True)
    if corrections is not None:
        chain = map_values(chain, "_city", corrections, "_city", True)
        chain = chain.withColumn("_city", normalize_text("_city"))
    chain = keep_known(chain, "_city", cities, to, mode).drop("_city")
    texts = texts.join(chain, "_place", "left").drop("_place")
    return df.join(texts, df[column].eqNullSafe(texts[column]), "left").drop(texts[column])
