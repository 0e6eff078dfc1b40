"""Mixing sources to target weights by a golden-ratio schedule of equal-token blocks.

Slots 0, 1, 2, ... are placed at the fractional parts of i times the golden ratio; the cumulative
weights of the sources cut the unit interval, and the point of a slot names its source. The rank of
a slot among those of its source names a block of the source's shuffled stream of words. Points of
this sequence fill every interval evenly, so every prefix of the schedule is near the weights. An
interval of few points is filled with an error of one or two of them: blocks are small enough that
every source has LEAST_SLOTS slots, and a source too small for that gets its exact number of slots,
one word each, at even distances.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.llm.arrays import word_count
from sessionloom.llm.storage import store

WEIGHTS = (5, 2, 1)
RING = 1 << 31  # points are integers below this
STEP = 1327217885  # odd, next to RING divided by the golden ratio
CELLS = 12  # the interval of a source is looked up by this many upper bits of a point, or more
LEAST_SLOTS = 300
BUCKETS = 4096
MOST_TIMES = 2


@dataclass(frozen=True)
class Mix:
    """sources: one row per source with size, target, blocks, slots; slots: the schedule (slot,
    source_no, rank, block), where slots of small sources share the number of another; docs: doc rows with their place in the stream of their source; taken:
    per doc row the words that the scheduled blocks take from it."""

    sources: DataFrame
    slots: DataFrame
    docs: DataFrame
    taken: DataFrame


def source_targets(sizes: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Targets of sources from (source, source_size): one row per source.

    Sources by code point, null last, have the weights in turn and share ``share`` times all words;
    a target stops at twice its source's size and the excess goes to the others by weight. The level
    at which that ends is read off the sources in the order of size by weight.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    cyc = F.array(*[F.lit(float(w)) for w in weights])
    numbered = sizes.withColumn("source_no", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(cyc, (F.col("source_no") % len(weights) + 1).cast("int"))
    )
    by_ratio = W.orderBy("_ratio", "source_no")
    ranked = (
        numbered.withColumn("_cap", F.lit(float(MOST_TIMES)) * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_caps", F.sum("_cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("_rest", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_all", F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    )
    level = (share * F.col("_all") - F.coalesce("_caps", F.lit(0.0))) / F.col("_rest")
    first = F.min(F.when(level <= F.col("_ratio"), F.struct("_ratio", "source_no", level.alias("level"))))
    everyone = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return ranked.select(
        "source",
        "source_no",
        "weight",
        "source_size",
        F.least(
            F.col("_cap"), F.coalesce(first.over(everyone)["level"] * F.col("weight"), F.col("_cap"))
        ).alias("target"),
    )


def row_key(text: str, seed: int) -> Column:
    """A seeded hash of doc_id and text as hexadecimal digits."""
    return F.md5(
        F.concat_ws(
            ":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")),
            F.md5(F.coalesce(F.col(text), F.lit(""))),
        )
    )


def word_streams(docs: DataFrame, text: str, seed: int) -> DataFrame:
    """doc_id, source, size of every row, with the row's start in the shuffled stream of its source.

    The order in a source is a seeded hash of doc_id and text; rows are summed by the upper part of
    that hash first, so no source is ordered in one task.
    """
    rows = docs.select(
        "doc_id", "source", word_count(F.col(text)).alias("size"), row_key(text, seed).alias("_key")
    )
    return store(rows.withColumn("_bucket", F.conv(F.substring("_key", 1, 3), 16, 10).cast("int")), "sizes")


def schedule(sources: DataFrame, seed_shift: int = 0) -> DataFrame:
    """The slots (slot, source_no, rank, block) for sources with ``slots`` and ``blocks``. Sources with
    less than LEAST_SLOTS have them counted out, not drawn."""
    spark = sources.sparkSession
    few = F.col("slots") < LEAST_SLOTS
    total = sources.agg(F.ceil(F.sum("slots")).cast("long").alias("n")).first()["n"] or 0
    # No more cells than intervals of LEAST_SLOTS have room for, so few intervals meet in a cell.
    cell_bits = 31 - min(24, max(CELLS, (total // LEAST_SLOTS).bit_length()))
    everyone = W.orderBy("source_no").rowsBetween(W.unboundedPreceding, 0)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cut = F.round(F.sum("slots").over(everyone) / F.sum("slots").over(whole) * RING).cast("long")
    spans = sources.withColumn("_to", cut).withColumn(
        "_from", F.coalesce(F.lag("_to").over(W.orderBy("source_no")), F.lit(0))
    ).where((F.col("_from") < F.col("_to")) & ~few)
    cells = spans.select(
        "source_no", "blocks", "_from", "_to",
        F.explode(
            F.sequence(F.shiftright("_from", cell_bits), F.shiftright(F.col("_to") - 1, cell_bits))
        ).alias("_cell"),
    )
    run = max(4096, total // 4096)
    point = F.pmod(((F.col("id") + seed_shift) % RING) * STEP, F.lit(RING))
    placed = (
        spark.range(total)
        .select(F.col("id").alias("slot"), point.alias("_point"))
        .withColumn("_cell", F.shiftright("_point", cell_bits))
        .join(cells, "_cell")
        .where((F.col("_point") >= F.col("_from")) & (F.col("_point") < F.col("_to")))
        .select("slot", "source_no", "blocks", F.expr(f"slot div {run}").alias("_run"))
    )
    in_run = placed.withColumn(
        "_place", F.row_number().over(W.partitionBy("source_no", "_run").orderBy("slot"))
    )
    counts = placed.groupBy("source_no", "_run").agg(F.count("*").alias("_n"))
    before = W.partitionBy("source_no").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select(
        "source_no", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    rank = F.col("_base") + F.col("_place") - 1
    drawn = in_run.join(base, ["source_no", "_run"]).select("slot", "source_no", "blocks", rank.alias("rank"))
    phase = F.pmod(F.col("source_no").cast("long") * STEP, F.lit(RING)) / RING
    counted = (
        sources.where(few).withColumn("_n", F.round("slots").cast("long")).where("_n > 0")
        .withColumn("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
        .select(
            F.floor((F.col("rank") + phase) / F.col("_n") * total).alias("slot"), "source_no", "blocks", "rank"
        )
    )
    return (
        drawn.union(counted)
        .where(F.col("rank") < MOST_TIMES * F.col("blocks"))
        .select("slot", "source_no", "rank", (F.col("rank") % F.col("blocks")).alias("block"))
    )


def mix(
    docs: DataFrame,
    text: str = "text",
    share: float = 1.5,
    weights: tuple[int, ...] = WEIGHTS,
    block_words: int | None = None,
    seed: int = 7,
) -> Mix:
    """Schedule of blocks that mixes the sources of ``docs`` to their targets.

    Blocks of a source differ by one word at most and have about ``block_words`` words; by default a
    500,000th of the mix, at least 8 and at most 4096. They are smaller, down to one word, in a source
    whose target would be less than LEAST_SLOTS of them. No block is used more than twice. A null text
    has no words; a null source is a source of its own; repeated rows count each.
    """
    rows = word_streams(docs, text, seed)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = store(source_targets(sizes, share, weights), "targets")
    if block_words is None:
        total = targets.agg(F.sum("target").alias("t")).first()["t"] or 0
        block_words = int(min(4096, max(8, total // 500_000)))
    own_words = F.least(F.lit(float(block_words)), F.greatest(F.lit(1.0), F.col("target") / LEAST_SLOTS))
    blocks = F.greatest(F.lit(1), F.round(F.col("source_size") / own_words).cast("long"))
    sources = targets.withColumn("blocks", blocks).withColumn(
        "slots",
        F.coalesce(F.try_divide(F.col("target") * F.col("blocks"), F.col("source_size")), F.lit(0.0)),
    )
    slots = schedule(sources)
    drawn = slots.groupBy("source_no").agg(F.count("*").alias("drawn"))
    known = store(
        sources.join(drawn, "source_no", "left")
        .select("source", "source_no", "source_size", "target", "blocks", F.coalesce("drawn", F.lit(0)).alias("drawn")),
        "drawn",
    )
    named = rows.join(
        F.broadcast(known) if targets.count() <= 10_000 else known, rows["source"].eqNullSafe(known["source"])
    ).drop(known["source"])
    before = W.partitionBy("source_no").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    base = (
        named.groupBy("source_no", "_bucket").agg(F.sum("size").alias("_n"))
        .select("source_no", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    inside = (
        W.partitionBy("source_no", "_bucket").orderBy("_key")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    placed = (
        named.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(base, ["source_no", "_bucket"])
        .withColumn("start", F.col("_base") + F.col("_before"))
    )
    # Block b of n covers the words from ceil(b * size / n) on. Ranks name the blocks in turn, so all
    # blocks are used equally often but for the first ones, which are used once more.
    more_to = F.expr("((drawn % blocks) * source_size + blocks - 1) div blocks")
    more = F.greatest(F.least(more_to, F.col("start") + F.col("size")) - F.col("start"), F.lit(0))
    columns = ["doc_id", "source", "source_no", "size", "source_size", "target", "start", "_key"]
    taken = placed.select(
        *columns,
        F.when(F.col("size") > 0, F.expr("drawn div blocks") * F.col("size") + more)
        .otherwise(0).cast("long").alias("taken"),
    )
    docs_in_place = placed.select(*columns[:6], "blocks", *columns[6:])
    return Mix(sources, slots, docs_in_place, taken)


def mixed_documents(docs: DataFrame, text: str = "text", seed: int = 7, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them: a row whose words are taken t times on
    average stands t times, rounded up or down by a hash so that sums stay near the targets. Equal
    rows stand equally often; a text without words has nothing to take and goes."""
    taken = mix(docs, text, seed=seed, **options).taken
    shares = taken.groupBy("_key").agg(F.try_divide(F.sum("taken"), F.sum("size")).alias("_times")).where("_times > 0")
    luck = F.conv(F.substring("_key", 9, 8), 16, 10).cast("double") / float(1 << 32)
    times = shares.withColumn("_copies", F.floor(F.col("_times") + luck).cast("int")).where("_copies > 0")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")  # names cannot clash in it
    keyed = docs.select(row, row_key(text, seed).alias("_key"))
    return (
        keyed.join(times.select("_key", "_copies"), "_key")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
    )
