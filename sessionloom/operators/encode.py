"""Encoders, binning and scaling; each takes the rows it is fitted on."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sessionloom.cluster import fresh_path, measured_broadcasts
from sessionloom.operators.lookup import attach
from sessionloom.operators.positions import number_in_order
from sessionloom.sources.files import stage

NAMED_PLACES = 10_000  # places of a vector that are named in the plan; the driver holds the names


def domain_codes(df: DataFrame, column: str, sentinel: str | None = None) -> DataFrame:
    """0-based codes of the sorted distinct values: ``column, code``."""
    domain = df.select(column).where(F.col(column).isNotNull())
    if sentinel is not None:
        extra = df.sparkSession.range(1).select(F.lit(sentinel).alias(column))
        domain = domain.union(extra)
    return number_in_order(domain.distinct(), column, "code")


def codes(
    df: DataFrame, column: str, fit_on: DataFrame | None = None, sentinel: str | None = None,
    unseen: int | None = None, to: str | None = None,
) -> DataFrame:
    """Code each value; unseen values get the sentinel's code, ``unseen``, or null."""
    domain = domain_codes(fit_on if fit_on is not None else df, column, sentinel)
    to = to or f"{column}_code"
    fills = {}
    if sentinel is not None:
        fills[to] = domain.where(F.col(column) == sentinel).select("code").scalar()
    elif unseen is not None:
        fills[to] = F.lit(unseen).cast("bigint")
    return attach(df, domain.withColumnRenamed("code", to), column, fills)


def narrow_values(df: DataFrame, column: str, at_most: int = 1000) -> list | None:
    """Sorted distinct values of a column, or None where it has more than ``at_most``."""
    found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(at_most + 1).collect()
    return sorted(row[0] for row in found) if len(found) <= at_most else None


def distinct_values(df: DataFrame, column: str, at_most: int = 1000) -> list:
    """Sorted distinct values of a narrow column; refuses a wide one."""
    found = narrow_values(df, column, at_most)
    if found is None:
        raise ValueError(f"{column} has over {at_most} values; use codes() or one_hot_vector() instead")
    return found


def one_hot(df: DataFrame, column: str, values: list, prefix: str, drop: bool = True) -> DataFrame:
    """A 0/1 column per value, named ``prefix_value``."""
    flags = {
        f"{prefix}_{v}": F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0))
        for v in values
    }
    wide = df.withColumns(flags)
    return wide.drop(column) if drop else wide


def one_hot_vector(
    df: DataFrame, column: str, to: str, fit_on: DataFrame | None = None, code: str | None = None
) -> DataFrame:
    """A sparse 0/1 vector per row, one place per distinct value in sorted order, for any number of
    values; null and unseen values give a vector of zeros.

    The dictionary is a table that is joined back, never a list on the driver; the column has a name
    for each place up to ``NAMED_PLACES``, beyond them their number only. ``code`` also keeps the
    place (null where there is none).
    """
    measured_broadcasts(df.sparkSession)
    domain = stage(
        domain_codes(fit_on if fit_on is not None else df, column), fresh_path(df.sparkSession, "dictionary")
    )
    size = max(domain.count(), 1)
    coded = attach(df, domain.withColumnRenamed("code", "_code"), column)
    if size > NAMED_PLACES:
        wide = coded.withColumn(to, unit_vector(F.col("_code"), size))
        wide = wide.withMetadata(to, {"ml_attr": {"num_attrs": size}})
    else:
        coded = coded.withColumn("_place", F.coalesce(F.col("_code"), F.lit(size)).cast("double"))
        # The place after the last value is the one the encoder drops, so it becomes zeros.
        encoder = OneHotEncoder(inputCol="_place", outputCol=to, dropLast=True)
        fitted = encoder.fit(df.sparkSession.range(1).select(F.lit(float(size)).alias("_place")))
        wide = fitted.transform(coded).drop("_place")
    return wide.withColumnRenamed("_code", code) if code else wide.drop("_code")


def unit_vector(place: Column, size: int) -> Column:
    """A sparse vector with a 1 at a place; zeros where that is null."""
    at, one = F.coalesce(place.cast("string"), F.lit("")), F.when(place.isNull(), "").otherwise("1.0")
    json = F.concat(F.lit(f'{{"v":{{"type":0,"size":{size},"indices":['), at, F.lit('],"values":['), one, F.lit("]}}"))
    return F.from_json(json, StructType().add("v", VectorUDT()))["v"]


def vector_totals(df: DataFrame, vector: str) -> DataFrame:
    """``at, total``: the sum of a column of sparse vectors at each place that any of them has.

    Equal vectors are counted first; their entries are summed place by place, so no task holds a number
    for every place.
    """
    counted = df.groupBy(F.col(vector).alias("v")).agg(F.count("*").alias("n"))
    form = StructType().add("v", VectorUDT().sqlType())
    held = F.from_json(F.to_json(F.struct("v")), form)["v"]
    entries = F.arrays_zip(held["indices"].alias("at"), held["values"].alias("value"))
    return counted.select("n", F.inline(entries)).groupBy("at").agg(F.sum(F.col("value") * F.col("n")).alias("total"))


def equal_width(df: DataFrame, column: str, labels: list[str], to: str) -> DataFrame:
    """Equal-width bins over the column's range, closed on the right; one value only: middle bin."""
    edges = df.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high"))).scalar()
    low, high = edges.getField("low"), edges.getField("high")
    n = len(labels)
    position = F.ceil(F.try_divide((F.col(column) - low) * n, high - low))
    bin_ = F.when(high == low, F.lit(n // 2 + 1)).otherwise(
        F.greatest(F.lit(1), F.least(F.lit(n), position))
    )
    bin_ = F.when(F.col(column).isNotNull(), bin_)
    names = F.array(*[F.lit(label) for label in labels])
    return df.withColumn(to, F.try_element_at(names, bin_.cast("int")))


def standardize(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population standard deviation of the rows fitted on; a constant gives 0."""
    fit_on = df if fit_on is None else fit_on
    stats = fit_on.agg(
        F.struct(
            *[F.avg(c).alias(f"{c}_mean") for c in columns],
            *[F.stddev_pop(c).alias(f"{c}_std") for c in columns],
        )
    ).scalar()
    scaled = {}
    for c in columns:
        std = stats.getField(f"{c}_std")
        divisor = F.when(std == 0, F.lit(1.0)).otherwise(std)
        scaled[c] = (F.col(c) - stats.getField(f"{c}_mean")) / divisor
    return df.withColumns(scaled)


def frequency_encode(
    df: DataFrame, column: str, fit_on: DataFrame, to: str | None = None
) -> DataFrame:
    """Share of the fitted rows with the same value; 0 for unseen values."""
    to = to or f"{column}_freq"
    total = fit_on.agg(F.count("*")).scalar()
    shares = (
        fit_on.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("_n"))
        .select(column, (F.col("_n") / total).alias(to))
    )
    return attach(df, shares, column, {to: 0.0})


def feature_vector(df: DataFrame, columns: list[str], to: str = "features") -> DataFrame:
    """One vector column; missing values become NaN inside it."""
    return VectorAssembler(inputCols=columns, outputCol=to, handleInvalid="keep").transform(df)
