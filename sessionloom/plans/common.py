"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


TIE_SHIFT = 3e-9


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating point columns rounded, so that two engines can be compared.

    Sums of doubles differ in the last bits with the order of rows. Means of amounts often lie
    exactly between two rounded values; the tiny shift puts both engines on the same side of it.
    """
    return df.withColumns(
        {
            c: F.round(F.col(c) + F.lit(TIE_SHIFT), digits)
            for c, kind in df.dtypes
            if kind in ("double", "float")
        }
    )


def sql_rounded(names: list[str], digits: int = 6) -> str:
    """Select list rounding the named columns in the same way."""
    return ", ".join(f"round({n} + {TIE_SHIFT}, {digits}) AS {n}" for n in names)


def train_part(events: DataFrame) -> DataFrame:
    return events.where(F.col("split") == "train")


def test_part(events: DataFrame) -> DataFrame:
    return events.where(F.col("split") == "test")


def key_hash_sql(key: str, seed: int) -> str:
    """``functions.ratios.key_hash`` for the SQL checks."""
    return f"CAST('0x' || substr(md5('{seed}:' || {key}), 1, 15) AS BIGINT)"


def least_squares_sql(features: list[str]) -> str:
    """Common table expressions that fit ``y`` on the features by least squares for the SQL checks.

    They follow ``ls0(g, id, fit, <features>, y)``: one fit per ``g`` on its rows with ``fit``, and end
    in ``fitted(g, id, y, prediction)``. Each feature is cleared of those before it, so that products
    with the label give one step of the prediction; a feature without anything left gives none.
    """
    names = [f"x{i}" for i in range(len(features))]
    steps = [
        "lsm AS (SELECT g, "
        + ", ".join(f"avg({c}) FILTER (fit) AS {n}" for c, n in zip(features, names))
        + ", avg(y) FILTER (fit) AS y FROM ls0 GROUP BY g)",
        "ls1 AS MATERIALIZED (SELECT ls0.g, id, fit, "
        + ", ".join(f"{c} - m.{n} AS {n}" for c, n in zip(features, names))
        + ", ls0.y - m.y AS y, ls0.y AS label, m.y AS p FROM ls0 JOIN lsm m USING (g))",
        "lsq AS (SELECT g, "
        + ", ".join(f"sum({n} * {n}) FILTER (fit) AS {n}" for n in names)
        + " FROM ls1 GROUP BY g)",
    ]
    for i, name in enumerate(names):
        rest = [*names[i + 1 :], "y"]
        part = ", ".join(
            f"CASE WHEN sum({name} * {name}) FILTER (fit) > 1e-9 * any_value(q.{name})"
            f" THEN sum(l.{c} * l.{name}) FILTER (fit) / sum(l.{name} * l.{name}) FILTER (fit) ELSE 0 END AS {c}"
            for c in rest
        ).replace(f"sum({name} * {name})", f"sum(l.{name} * l.{name})")
        steps.append(f"lsd{i + 1} AS (SELECT g, {part} FROM ls{i + 1} l JOIN lsq q USING (g) GROUP BY g)")
        steps.append(
            f"ls{i + 2} AS MATERIALIZED (SELECT l.g, id, fit, "
            + ", ".join(f"l.{c} - d.{c} * l.{name} AS {c}" for c in rest)
            + f", label, p + d.y * l.{name} AS p FROM ls{i + 1} l JOIN lsd{i + 1} d USING (g))"
        )
    steps.append(
        f"fitted AS (SELECT g, id, label AS y, p AS prediction FROM ls{len(names) + 1})"
    )
    return ",\n".join(steps)
