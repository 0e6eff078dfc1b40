"""Steps on columns and rows: names, schemas, alignment, filters, splits and unions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_names(df: DataFrame) -> DataFrame:
    """Keep only ASCII letters and white space in column names."""
    return df.toDF(*[re.sub(r"[^a-zA-Z\s]", "", name) for name in df.columns])


def blank_to_null(df: DataFrame) -> DataFrame:
    """Empty text becomes null."""
    return df.withColumns(
        {c: F.nullif(F.col(c), F.lit("")) for c, kind in df.dtypes if kind == "string"}
    )


def columns_of_type(df: DataFrame, *kinds: str) -> list[str]:
    return [name for name, kind in df.dtypes if kind in kinds]


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    return [name for name in df.columns if re.search(pattern, name)]


def drop_first(df: DataFrame, n: int = 1) -> DataFrame:
    return df.select(*df.columns[n:])


def sort_columns(df: DataFrame) -> DataFrame:
    return df.select(*sorted(df.columns))


def cast_all(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Cast the named columns that exist; a value that does not fit becomes null."""
    return df.withColumns(
        {name: F.col(name).try_cast(kind) for name, kind in spec.items() if name in df.columns}
    )


def align_to(df: DataFrame, columns: list[str], fill: float | int | str = 0) -> DataFrame:
    """Exactly these columns in this order: missing ones filled, others dropped."""
    present = set(df.columns)
    return df.select(*[F.col(c) if c in present else F.lit(fill).alias(c) for c in columns])


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    other = set(b.columns)
    return [name for name in a.columns if name in other]


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of only one of two tables: ``column_name, only_in``."""
    rows = [(name, "left") for name in a.columns if name not in set(b.columns)]
    rows += [(name, "right") for name in b.columns if name not in set(a.columns)]
    schema = T.StructType(
        [T.StructField("column_name", T.StringType()), T.StructField("only_in", T.StringType())]
    )
    return a.sparkSession.createDataFrame(rows, schema)


def label_column(template: DataFrame) -> str:
    """The label is the last column of a submission template."""
    return template.columns[-1]


def masked(condition: Column, value: object, column: str) -> Column:
    """``value`` where the condition holds, else the column as it is."""
    return F.when(condition, F.lit(value)).otherwise(F.col(column))


def not_null_flag(column: str) -> Column:
    return F.col(column).isNotNull().cast("int")


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Drop every column with a null in it; one pass counts the nulls of all columns."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if counts[c]])


def stack_parts(parts: dict[str, DataFrame], name: str = "split") -> DataFrame:
    """Union by column name with the origin of each row written into ``name``."""
    frames = [df.withColumn(name, F.lit(part)) for part, df in parts.items()]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def one_row_per(df: DataFrame, key: str, value: str, by: list[str]) -> DataFrame:
    """One value per key, the first non-null one in the order ``by``; never multiplies rows."""
    first = F.when(F.col(value).isNotNull(), F.struct(*by))
    return df.groupBy(key).agg(F.min_by(value, first).alias(value))
