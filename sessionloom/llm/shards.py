"""Shards in random order by a two-pass external shuffle, with built-in Spark functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm.storage import fresh_path, parts_for, store

SHARDS = 16
SEED = 12
BUCKET_BYTES = 32 << 20
BUCKET_ROWS = 1 << 20
MOST_BUCKETS = 100_000  # beyond, buckets grow with the table: at 100 TB they hold 1 GB
ORDERS_A_TASK = 1000  # orders of buckets drawn by one task


def hashed(rows: DataFrame, seed: int) -> DataFrame:
    """``h1, h2, record``: two seeded hashes over all columns and which of them are null, and the row
    as a struct."""
    columns = [F.col(f"`{c}`") for c in rows.columns]
    facts = [*columns, *[c.isNull() for c in columns]]
    return rows.select(
        F.xxhash64(F.lit(seed), *facts).alias("h1"),
        F.xxhash64(F.lit(seed + 1), *facts).alias("h2"),
        F.struct(*columns).alias("record"),
    )


def repeated_rows(plain: DataFrame, again: DataFrame) -> DataFrame:
    """The rows whose hashes are in ``again``, with ``copy``, a number from 1 among equal rows.

    Equal rows cannot be told apart: they are counted with partial counts and dealt out again by
    their number, which is the same table, and no task holds all copies of one row.
    """
    counted = (
        plain.join(again, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "record").agg(F.count("*").alias("n"))
    )
    number = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    return counted.select("h1", "h2", "record", number.alias("copy"))


def bucket_orders(keys: DataFrame, buckets: int, seed: int) -> DataFrame:
    """``bucket, base, order``: the number of rows in the buckets before, and a Fisher-Yates order of
    the bucket's places.

    ``shuffle`` draws from the seed and the number of its task, so buckets go to a fixed number of
    tasks, are sorted there, and the orders are written before anything reads them.
    """
    groups = keys.groupBy("bucket").agg(F.count("*").cast("int").alias("n"))
    groups = groups.withColumn("task", F.floor(F.col("bucket") / ORDERS_A_TASK))
    # Two levels of running totals: one task sees the buckets of a group, one the groups.
    before = W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    totals = groups.groupBy("task").agg(F.sum("n").alias("rows"))
    starts = totals.select("task", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("task").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    based = groups.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, "task")
    ordered = based.repartition(parts_for(buckets, ORDERS_A_TASK), "task").sortWithinPartitions("bucket")
    return store(
        ordered.select(
            "bucket",
            (F.col("start") + F.col("inside")).alias("base"),
            F.shuffle(F.sequence(F.lit(0), F.col("n") - 1), F.lit(seed)).alias("order"),
        ),
        "orders",
    )


def write_shards(
    rows: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES,
    weight: str = "text", folder: str | None = None,
) -> str:
    """Write all rows in random order to ``shards`` folders and return their path.

    First pass: a seeded hash of the whole row scatters rows over buckets of about ``bucket_bytes``
    bytes of the column ``weight``, whatever the input's order, sources or groups. Second pass: the
    rows of a bucket, sorted by their hashes, take the places of a Fisher-Yates order and are
    written. Buckets follow each other, so a row's place among all rows is its bucket's base plus its
    own place; shard s holds the s-th of ``shards`` even runs of places: counts differ by one at most.

    Files hold ``slot``, from 0 without gaps in each shard, and ``record``, the row as a struct, so
    no column name can clash; folder names hold the shard. The order depends on the rows, the seed and
    the size of buckets, not on the input's order or partitions. Null and empty texts weigh nothing, a
    text longer than a bucket makes its bucket longer, equal rows have a slot each, and an empty table
    has no rows in any shard.
    """
    spark = rows.sparkSession
    folder = folder or fresh_path(spark, "shards")
    plain = hashed(rows, seed)
    size = F.octet_length(F.col("record").getField(weight).cast("string")).cast("long").alias("bytes")
    keys = store(plain.select("h1", "h2", size), "keys")
    facts = keys.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    n = facts["n"]
    buckets = max(parts_for(facts["bytes"], bucket_bytes), parts_for(n, BUCKET_ROWS))
    buckets = min(buckets, MOST_BUCKETS)

    again = store(keys.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "again")
    one = F.lit(0).cast("long").alias("copy")
    if again.isEmpty():
        numbered, light = plain.select("*", one), keys.select("h1", "h2", one)
    else:
        copies = store(repeated_rows(plain, again), "copies")
        numbered = plain.join(again, ["h1", "h2"], "left_anti").select("*", one).unionByName(copies)
        light = keys.join(again, ["h1", "h2"], "left_anti").select("h1", "h2", one)
        light = light.unionByName(copies.select("h1", "h2", "copy"))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "h1", "h2", "copy"), F.lit(buckets)).alias("bucket")
    orders = bucket_orders(light.select(bucket), buckets, seed)

    rank = F.row_number().over(W.partitionBy("bucket").orderBy("h1", "h2", "copy"))
    dealt = numbered.select("*", bucket).repartition(buckets, "bucket").withColumn("rank", rank)
    place = F.col("base") + F.element_at("order", F.col("rank"))
    placed = dealt.join(orders, "bucket").select("record", place.alias("place"))
    placed = placed.withColumn("shard", F.expr(f"(place * {shards}L) div {max(n, 1)}L"))
    slot = F.col("place") - F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")
    out = placed.select(F.col("shard").cast("int").alias("shard"), slot.alias("slot"), "record")
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    return folder


def read_shards(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """``slot, record, shard`` read back from the files; ``schema`` is that of the rows written."""
    fields = [
        T.StructField("slot", T.LongType()), T.StructField("record", schema),
        T.StructField("shard", T.IntegerType()),
    ]
    return spark.read.schema(T.StructType(fields)).parquet(folder)


def document_slots(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Where each document stands in the written shards: doc_id, size (UTF-8 bytes plus 1),
    text_crc32, law, shard, slot, grown_shard, from the files. A null text is an empty one."""
    columns = docs.select("doc_id", "text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    folder = write_shards(columns, shards)
    written = read_shards(docs.sparkSession, folder, columns.schema)
    text = F.encode(F.coalesce(F.col("record.text"), F.lit("")), "UTF-8")
    return written.select(
        F.col("record.doc_id").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
