"""Number expressions: ratios, clipping, rounding, periodic encoding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.moments import as_column


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, and 0 where b is 0 or either side is missing."""
    return F.coalesce(plain_ratio(a, b), F.lit(0.0))


def plain_ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, and null where b is 0."""
    return F.try_divide(as_column(a).cast("double"), as_column(b).cast("double"))


def smooth_ratio(a: Column | str, b: Column | str) -> Column:
    """a / (b + 1)."""
    return as_column(a).cast("double") / (as_column(b) + 1)


def per_unit(a: Column | str, b: Column | str) -> Column:
    """a / b with a zero divisor read as one."""
    divisor = as_column(b)
    return as_column(a).cast("double") / F.when(divisor == 0, F.lit(1)).otherwise(divisor)


def cyclical(value: Column | str, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a value that repeats after ``period``."""
    angle = as_column(value) * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def clip_low(value: Column | str, low: float = 0.0) -> Column:
    """The value, but not below ``low``; a missing value stays missing."""
    column = as_column(value)
    return F.when(column < low, F.lit(low)).otherwise(column)


def finite(value: Column | str, instead: float | None = None) -> Column:
    """Infinite values and NaN replaced, by null unless told otherwise."""
    column = as_column(value)
    bad = F.isnan(column) | (F.abs(column) == F.lit(float("inf")))
    return F.when(bad, F.lit(instead)).otherwise(column)


def finite_columns(df: DataFrame, instead: float | None = None) -> DataFrame:
    """``finite`` on every floating point column."""
    return df.withColumns(
        {c: finite(c, instead) for c, kind in df.dtypes if kind in ("double", "float")}
    )


def money_sum(value: Column | str) -> Column:
    """Sum of amounts with two decimals; exact, so independent of the order of partitions."""
    return F.sum(as_column(value).cast("decimal(18,2)")).cast("double")


def money_mean(value: Column | str) -> Column:
    """Mean of amounts with two decimals, from an exact sum."""
    return F.try_divide(money_sum(value), F.count(as_column(value)).cast("double"))


def round_even(value: Column | str, digits: int) -> Column:
    """Round half to even on the scaled double, the way array libraries do."""
    scale = F.lit(10.0**digits)
    return F.rint(as_column(value) * scale) / scale


def key_hash(key: Column | str, seed: int) -> Column:
    """Seeded 60-bit hash of a key that any engine with MD5 can repeat."""
    text = F.concat_ws(":", F.lit(str(seed)), as_column(key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
