"""Profiles of a table: nulls, domains, quantiles, correlation, histograms, outliers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.operators.columns import columns_of_type

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _long(row: DataFrame, names: list[str], key: str, fields: dict[str, str]) -> DataFrame:
    """One wide row of aggregates (``field__name``) as one row per name."""
    parts = [
        F.struct(F.lit(n).alias(key), *[F.col(f"{f}__{n}").alias(f) for f in fields]) for n in names
    ]
    return row.select(F.explode(F.array(*parts)).alias("_row")).select("_row.*")


def null_profile(df: DataFrame) -> DataFrame:
    """Columns with nulls and how many, most first."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_null__{c}") for c in df.columns])
    counts = _long(row, df.columns, "column_name", {"n_null": "bigint"})
    return counts.where("n_null > 0").orderBy(F.desc("n_null"), "column_name")


def domain_profile(df: DataFrame, columns: list[str], list_up_to: int = 20) -> DataFrame:
    """Distinct count of each column, its sorted values listed where they are few."""
    pairs = (
        df.select(*[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot([], columns, "column_name", "_value")
        .where(F.col("_value").isNotNull())
        .distinct()
    )
    counts = pairs.groupBy("column_name").agg(F.count("*").alias("n_distinct"))
    small = counts.where(F.col("n_distinct") <= list_up_to).select("column_name")
    listed = (
        pairs.join(small, "column_name", "left_semi")
        .groupBy("column_name")
        .agg(F.array_join(F.array_sort(F.collect_list("_value")), ",").alias("listed_values"))
    )
    return counts.join(listed, "column_name", "left")


def table_profile(df: DataFrame) -> DataFrame:
    """Rows, columns and columns per type."""
    kinds: dict[str, int] = {}
    for _, kind in df.dtypes:
        kinds[kind] = kinds.get(kind, 0) + 1
    facts = [("columns", len(df.columns)), *[(f"type {k}", n) for k, n in sorted(kinds.items())]]
    rows = df.agg(F.count("*").alias("n"))
    entries = [F.struct(F.lit("rows").alias("fact"), F.col("n").alias("n"))]
    entries += [F.struct(F.lit(f).alias("fact"), F.lit(n).cast("bigint").alias("n")) for f, n in facts]
    return rows.select(F.explode(F.array(*entries)).alias("_fact")).select("_fact.*")


def exact_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], accuracy: int = 10_000,
    keep: int = 100_000,
) -> dict[str, list[float]]:
    """Exact quantiles with linear interpolation, without gathering a column in one task.

    A mergeable sketch proposes a narrow range of values around each quantile, a counting pass
    confirms it, and only rows inside the range matter from then on. This repeats until at most
    ``keep`` rows are left, whose values are counted and ranked. Only range ends and counts reach
    the driver.
    """
    targets = [(c, p) for c in columns for p in probs]

    def around(i: int, fraction: float) -> list[float]:
        return [max(0.0, fraction - margin[i]), min(1.0, fraction + margin[i])]

    def inside(i: int, low: float, high: float) -> Column:
        column = F.col(targets[i][0])
        return F.when(column.between(low, high), column)

    margin = dict.fromkeys(range(len(targets)), 2.0 / accuracy)
    first = df.agg(
        *[F.count(c).alias(f"n_{c}") for c in columns],
        *[F.min(c).alias(f"min_{c}") for c in columns],
        *[F.max(c).alias(f"max_{c}") for c in columns],
        # One sketch per column answers for all its quantiles.
        *[
            F.percentile_approx(
                c, [end for i, (d, p) in enumerate(targets) if d == c for end in around(i, p)], accuracy
            ).alias(f"s_{c}")
            for c in columns
        ],
    ).first()
    rank = {i: (first[f"n_{c}"] - 1) * p for i, (c, p) in enumerate(targets)}
    range_ = {i: (first[f"min_{c}"], first[f"max_{c}"]) for i, (c, _) in enumerate(targets)}
    below = dict.fromkeys(range_, 0)
    within = {i: first[f"n_{c}"] for i, (c, _) in enumerate(targets)}
    proposed = {}
    for i, (c, p) in enumerate(targets):
        if within[i] > keep:
            at = 2 * probs.index(p)
            proposed[i] = tuple(first[f"s_{c}"][at : at + 2])
    while proposed:
        seen = df.agg(
            *[F.count_if(F.col(targets[i][0]) < low).alias(f"b_{i}") for i, (low, _) in proposed.items()],
            *[F.count(inside(i, *ends)).alias(f"i_{i}") for i, ends in proposed.items()],
        ).first()
        for i, ends in proposed.items():
            under, among = seen[f"b_{i}"], seen[f"i_{i}"]
            if under <= math.floor(rank[i]) and math.ceil(rank[i]) < under + among:
                range_[i], below[i], within[i] = ends, under, among
            else:
                margin[i] *= 4
        wide = [i for i in proposed if range_[i][0] < range_[i][1] and within[i] > keep]
        if not wide:
            break
        again = df.agg(
            *[
                F.percentile_approx(
                    inside(i, *range_[i]), around(i, (rank[i] - below[i]) / within[i]), accuracy
                ).alias(f"s_{i}")
                for i in wide
            ]
        ).first()
        # A range that does not shrink any more holds few values with many copies each.
        proposed = {i: tuple(again[f"s_{i}"]) for i in wide if tuple(again[f"s_{i}"]) != range_[i]}

    filled = [i for i in range_ if within[i]]
    keys = [str(i) for i in filled]

    def wanted(place) -> Column:
        ranks = [F.lit(x) for i in filled for x in (str(i), place(rank[i]) - below[i])]
        return F.try_element_at(F.create_map(*ranks), F.col("_target"))

    found = {}
    if filled:
        values = (
            df.select(*[inside(i, *range_[i]).cast("double").alias(str(i)) for i in filled])
            .unpivot([], keys, "_target", "_v")
            .where(F.col("_v").isNotNull())
            .groupBy("_target", "_v")
            .agg(F.count("*").alias("_n"))
            .withColumn("_upto", F.sum("_n").over(W.partitionBy("_target").orderBy("_v")))
        )
        ends = values.groupBy("_target").agg(
            F.min(F.when(F.col("_upto") > wanted(math.floor), F.col("_v"))).alias("low"),
            F.min(F.when(F.col("_upto") > wanted(math.ceil), F.col("_v"))).alias("high"),
        )
        found = {int(row["_target"]): (row["low"], row["high"]) for row in ends.collect()}
    result: dict[str, list[float]] = {c: [] for c in columns}
    for i, (c, _) in enumerate(targets):
        low, high = found.get(i, (math.nan, math.nan))
        result[c].append(low + (high - low) * (rank[i] - math.floor(rank[i])))
    return result


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum: one row per column."""
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    aggs = []
    for c in columns:
        low, middle, high = quartiles[c]
        aggs += [
            F.count(c).alias(f"count__{c}"),
            F.avg(c).alias(f"mean__{c}"),
            F.stddev_samp(c).alias(f"std__{c}"),
            F.min(c).cast("double").alias(f"min__{c}"),
            F.lit(low).alias(f"q25__{c}"),
            F.lit(middle).alias(f"median__{c}"),
            F.lit(high).alias(f"q75__{c}"),
            F.max(c).cast("double").alias(f"max__{c}"),
        ]
    fields = ["count", "mean", "std", "min", "q25", "median", "q75", "max"]
    return _long(df.agg(*aggs), columns, "column_name", dict.fromkeys(fields, "double"))


def iqr_filter(
    df: DataFrame, column: str, k: float = 1.5, fit_on: DataFrame | None = None
) -> DataFrame:
    """Rows within k interquartile ranges of the quartiles, both bounds included."""
    fit_on = df if fit_on is None else fit_on
    low, high = exact_quantiles(fit_on, [column], [0.25, 0.75])[column]
    reach = k * (high - low)
    return df.where(F.col(column).between(low - reach, high + reach))


def corr_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(
        *[
            F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}")
            for a, b in pairs
        ]
    )
    cells = [
        F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"{a}__{b}").alias("r"))
        for a, b in pairs
        for x, y in ([(a, b)] if a == b else [(a, b), (b, a)])
    ]
    return row.select(F.explode(F.array(*cells)).alias("_cell")).select("_cell.*")


def corr_with(
    df: DataFrame, columns: list[str], label: str, min_abs: float = 0.0
) -> DataFrame:
    """Correlation of each column with the label, strongest first."""
    row = df.agg(
        *[
            F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(f"r__{c}")
            for c in columns
        ]
    )
    found = _long(row, columns, "column_name", {"r": "double"})
    return found.where(F.abs("r") >= min_abs).orderBy(F.desc(F.abs("r")), "column_name")


def keep_correlated(df: DataFrame, label: str, min_abs: float = 0.4) -> DataFrame:
    """Only the numeric columns whose correlation with the label is strong enough, and the label."""
    numbers = [c for c in columns_of_type(df, *NUMBERS) if c != label]
    kept = {row["column_name"] for row in corr_with(df, numbers, label, min_abs).collect()}
    return df.select(*[c for c in df.columns if c in kept or c == label])


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Rows per equal-width bin from minimum to maximum, empty bins included."""
    edges = df.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high"))).scalar()
    low, high = edges.getField("low"), edges.getField("high")
    position = F.floor(F.try_divide((F.col(column) - low) * bins, high - low))
    bin_ = F.least(F.coalesce(position, F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(column).isNotNull()).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (high - low) / bins
    return every.join(counts, "bin", "left").select(
        "bin",
        (low + F.col("bin") * width).alias("bin_start"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
