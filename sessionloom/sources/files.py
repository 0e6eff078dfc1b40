"""Readers, writers and checks of files in storage every executor can reach."""

from __future__ import annotations

import csv
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_time", T.TimestampNTZType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("category_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("user_session", T.StringType()),
        T.StructField("session_value", T.DoubleType()),
    ]
)

CSV_OPTIONS = {
    "header": "true",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "escape": '"',
    "multiLine": "false",
}


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    return spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
    return path


REJECTED = "_rejected"


def file_headers(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """The files of a path by their first line; files without one are left out.

    Lines are read by Spark and one comes back per file, as many as the file index holds anyway.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"),
    )
    first = lines.where("_metadata.file_block_start = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    groups: dict[str, list[str]] = {}
    for row in first.orderBy("file").toLocalIterator():
        if row["header"].strip():
            groups.setdefault(row["header"], []).append(unquote(row["file"]))
    return groups


def header_names(header: str) -> list[str]:
    """Column names of a header line; a name that repeats keeps its first place."""
    names = [name.strip() for name in next(csv.reader([header.lstrip("\ufeff")]))]
    return [n if n and n not in names[:i] else f"_column{i}" for i, n in enumerate(names)]


def raw_event_rows(spark: SparkSession, path: str | list[str], schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """Rows of event files as text columns in the order of ``schema``, with ``file_path`` and whether
    the row had another number of fields than its header (``_rejected``).

    Files are grouped by their header; each group is one scan with its own columns, picked by name.
    """
    parts = []
    for header, files in file_headers(spark, path).items():
        names = header_names(header)
        there = set(names)
        fields = [T.StructField(n, T.StringType()) for n in [*names, REJECTED]]
        # Without all columns the parser would not see that a row is cut short.
        rows = spark.read.options(**CSV_OPTIONS, columnNameOfCorruptRecord=REJECTED, columnPruning="false")
        rows = rows.schema(T.StructType(fields)).csv(files)
        parts.append(
            rows.select(
                *[
                    (F.col(f"`{f.name}`") if f.name in there else F.lit(None).cast("string")).alias(f.name)
                    for f in schema.fields
                ],
                F.col("_metadata.file_path").alias("file_path"),
                # Spark wants another column of the file beside this one in every query.
                (F.col(REJECTED).isNotNull() & (F.length(F.coalesce(F.col(f"`{names[0]}`"), F.lit(""))) >= 0))
                .alias(REJECTED),
            )
        )
    if not parts:
        empty = ", ".join(f"`{f.name}` string" for f in schema.fields)
        return spark.createDataFrame([], f"{empty}, file_path string, {REJECTED} boolean")
    return reduce(DataFrame.unionByName, parts)


def read_events(spark: SparkSession, path: str | list[str], schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """An event log from CSV files with headers, which may differ from file to file.

    Columns are found by name in any order; a missing one is null. Times may have a ``T`` or a space,
    fractions, and a zone or offset (then in UTC); NaN and infinite numbers are null. Rows with
    another number of fields than their header are left out; ``event_file_report`` counts them.
    """
    rows = raw_event_rows(spark, path, schema).where(~F.col(REJECTED))
    return rows.select(*[_typed(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in schema.fields])


def event_file_report(spark: SparkSession, path: str | list[str], schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """Per file: rows read, rows rejected, and per column that is not text the values of kept rows that
    are given but cannot be read."""
    rows = raw_event_rows(spark, path, schema)
    typed = [f for f in schema.fields if not isinstance(f.dataType, T.StringType)]
    bad = [
        F.count_if(
            ~F.col(REJECTED) & F.col(f"`{f.name}`").isNotNull() & _typed(F.col(f"`{f.name}`"), f.dataType).isNull()
        ).alias(f"unread_{f.name}")
        for f in typed
    ]
    return rows.groupBy("file_path").agg(
        F.count("*").alias("n_rows"), F.count_if(REJECTED).alias("n_rejected"), *bad
    )


def _typed(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampNTZType):
        zoned = text.rlike(r":.*(Z|UTC|[+-]\d{2}:?\d{2})$")
        moment = F.convert_timezone(None, F.lit("UTC"), text.try_cast("timestamp").cast("timestamp_ntz"))
        return F.when(zoned, moment).otherwise(text.try_cast("timestamp_ntz"))
    value = text.try_cast(kind)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    return value


def unparsed_times(spark: SparkSession, path: str, column: str = "event_time") -> int:
    """Rows of event files whose time is given but in no form that can be read."""
    raw = spark.read.options(**CSV_OPTIONS).csv(path).select(F.col(column).alias("t"))
    return raw.where(F.col("t").isNotNull() & _typed(F.col("t"), T.TimestampNTZType()).isNull()).count()


def read_many(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """All files of a name pattern, each row with the name of its file."""
    df = spark.read.options(**CSV_OPTIONS).schema(schema).csv(pattern)
    return df.select("*", F.col("_metadata.file_path").alias("file_path"))


def read_lookup(spark: SparkSession, path: str, names: tuple[str, str] = ("city", "district")):
    """A two-column sheet whose first data row repeats the heading and is skipped.

    ``ord`` orders the rows as they stand in the files.
    """
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    at = F.struct(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = read_csv(spark, path, schema).select(*names, at.alias("ord"))
    return rows.where(F.col("ord") != rows.agg(F.min("ord")).scalar())


def read_json_map(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """JSON objects of text to text as rows ``key, value``: one per file, or one per line."""
    objects = spark.read.text(path, wholetext=not one_per_line)
    return objects.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def read_json_list(spark: SparkSession, path: str) -> DataFrame:
    """One JSON list of texts as rows ``ord, item``."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("ord", "item"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder with their length; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length")


def write_predictions(df: DataFrame, path: str, variant: str | None = None) -> str:
    """Predictions as CSV; with a variant column, one folder per variant from one job."""
    writer = df.write.mode("overwrite").options(**CSV_OPTIONS)
    if variant is not None:
        writer = writer.partitionBy(variant)
    writer.csv(path)
    return path


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write a step's output and go on from the files."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def unstage(spark, path: str) -> None:
    """Delete a staged table that no step reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def check_written(df: DataFrame) -> DataFrame:
    """Row count and nulls per column of a table read back."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns]
    return df.agg(F.count("*").alias("n_rows"), *nulls)


def head_tail(df: DataFrame, order: str, n: int) -> DataFrame:
    """First and last n rows by a key."""
    first = df.orderBy(order).limit(n).withColumn("part", F.lit("head"))
    last = df.orderBy(F.desc(order)).limit(n).withColumn("part", F.lit("tail"))
    return first.unionByName(last)
