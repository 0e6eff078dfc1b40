"""Text similarity: TF-IDF weights, similar pairs, average-linkage clusters, mean vectors."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, IntegralType, LongType, StringType, StructType

from sessionloom.cluster import batch_settings, fresh_path
from sessionloom.sources.files import stage, unstage

WORD = r"(?U)\b\w\w+\b"
HOT_ROWS = 2_000  # rows of one term on each side of a join cell
SMALL_IDS = 1_000_000  # ids that are broadcast to pick vectors; beyond, they are joined by shuffle
SLACK = 1e-9
UNIT = 32_000  # of a weight of 1 in an outline
BLOCK_TEXTS = 2_000  # texts whose words meet their frequencies together
ROW_WORDS = 4_000  # words of a block in one row
CELL_ROWS = 4_000  # vectors that meet in one group to be compared, or 3 times as many outlines
CELL_PAIRS = 300_000  # pairs compared in one group
CELL_ENTRIES = 1 << 20  # entries compared at once
MEETINGS = 100_000_000  # of vectors in a term that are followed up at once, or
HEAD_MEETINGS = 20  # times as many as there are entries in which vectors can meet
MOVED_PAIRS = 1_000_000  # for which outlines are moved at once
TIED_LINKS = 4_000_000  # links in which one task finds what is tied together
TIE_ROWS = 2_500  # vectors tied together that are merged in one task


def term_counts(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """``id, digest, terms``: the distinct words of two characters or more of each text with their
    counts, and the SHA-256 of the text.

    Counted inside the row, from the sorted words and the places where a new one starts.
    """
    found = F.coalesce(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))
    sorted_ = docs.select(F.col(id_).alias("id"), F.sha2(text, 256).alias("digest"), F.sort_array(found).alias("s"))
    starts = F.filter(
        F.when(F.size("s") > 0, F.sequence(F.lit(0), F.size("s") - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: (i == 0) | (F.col("s")[i] != F.col("s")[F.greatest(i - 1, F.lit(0))]),
    )
    # The generator keeps the sorted words a column of their own, computed once.
    placed = sorted_.select("id", "digest", F.inline(F.array(F.struct("s", starts.alias("at")))))
    after = lambda k: F.coalesce(F.get(F.col("at"), k + 1), F.size("s"))
    terms = F.transform(
        "at", lambda i, k: F.struct(F.col("s")[i].alias("term"), (after(k) - i).cast("long").alias("tf"))
    )
    return placed.select("id", "digest", terms.alias("terms"))


def first_of_each(counted: DataFrame) -> DataFrame:
    """Of rows with one digest the one with the smallest id; few ids are broadcast, so that rows are
    not shuffled."""
    first = counted.groupBy("digest").agg(F.min("id").alias("id")).select("id")
    first = stage(first, fresh_path(counted.sparkSession, "first"))
    if first.limit(SMALL_IDS + 1).count() <= SMALL_IDS:
        first = F.broadcast(first)
    return counted.join(first, "id", "left_semi")


def tfidf_vectors(
    docs: DataFrame, id_: str, text: str, max_terms: int | None = None, once: bool = False,
    shared: bool = False,
) -> DataFrame:
    """``id, entries``: one sparse vector of unit length per text, entries (df, term, w) from the rarest
    term to the most common; smooth idf, all terms or the ``max_terms`` most frequent.

    Ties in the cut go to the earlier term. With ``once``, equal texts are one, under the smallest id.
    With ``shared``, entries of terms that no other text has are left out after they have counted for
    the length, as they add to no dot product; ``alone`` says whether there were any, and texts with
    none left keep their row. Texts without a counted term have no row. Words are counted in one pass.
    Counts are written, weights are worked out again.
    """
    spark = docs.sparkSession
    met, weighted, path = _met(docs, id_, text, max_terms, once, shared)
    kept = _stage(met, fresh_path(spark, "vectors"))
    unstage(spark, path)
    return kept.select("id", weighted, *(["alone"] if shared else []))


def _met(
    docs: DataFrame, id_: str, text: str, max_terms: int | None, once: bool, shared: bool
) -> tuple[DataFrame, Column, str]:
    """``id, e, length`` of the texts, ``alone`` with ``shared``, with the column that weighs ``e``, and
    the folder they are read from.

    Texts are gathered in blocks where they are; a block numbers its words. Each word goes out once
    for every block that has it, and comes back to it as a number with its frequency.
    """
    spark = docs.sparkSession
    batch_settings(spark)
    path = fresh_path(spark, "terms")
    counted = _stage(term_counts(docs, id_, text), path)
    if once:
        counted = first_of_each(counted)
    n = counted.count()
    blocks_path = fresh_path(spark, "blocks")
    blocks = stage(text_blocks(counted.where(F.size("terms") > 0).select("id", "terms")), blocks_path)
    unstage(spark, path)
    words = blocks.where("words IS NOT NULL").select("block", "first", F.posexplode("words").alias("_k", "_word"))
    terms = words.groupBy("_word.term").agg(
        F.sum("_word.tf").alias("_total"), F.sum("_word.n").alias("df"),
        F.collect_list(F.struct(F.col("block").alias("into"), (F.col("first") + F.col("_k")).alias("at"))).alias("_places"),
    )
    if max_terms is not None:
        terms = terms.orderBy(F.desc("_total"), "term").limit(max_terms)
    known = terms.select(F.inline("_places"), "df")
    entry = StructType().add("df", LongType()).add("term", StringType()).add("tf", LongType())
    form = StructType([counted.schema["id"]]).add("alone", LongType()).add("e", ArrayType(entry))

    def meet(rows: pa.Table, known: pa.Table) -> pa.Table:
        return _frequent(rows, known, shared)

    met = blocks.groupBy("block").cogroup(known.groupBy("into")).applyInArrow(meet, form)
    idf = lambda df: F.log((n + 1) / (df + 1)) + 1
    square = F.aggregate("e", F.lit(0.0), lambda total, e: total + F.pow(e["tf"] * idf(e["df"]), F.lit(2)))
    length = F.sqrt(square + F.col("alone") * F.pow(idf(F.lit(1)), F.lit(2))).alias("length")
    alone = [(F.col("alone") > 0).alias("alone")] if shared else []
    weighted = lambda e: F.struct(
        e["df"].alias("df"), e["term"].alias("term"), (e["tf"] * idf(e["df"]) / F.col("length")).alias("w")
    )
    return met.select("id", "e", length, *alone), F.transform("e", weighted).alias("entries"), blocks_path


def text_blocks(placed: DataFrame) -> DataFrame:
    """Texts ``id, terms`` in blocks where they are, those of a repeated id in one block.

    Rows ``block, id, steps, tf`` for the texts, the numbers of their words from one to the next, and
    ``block, first, words`` for the words of the block, some in a row, numbered in sorted order.
    """
    spark = placed.sparkSession
    most, entries = BLOCK_TEXTS, CELL_ENTRIES
    word = StructType().add("term", StringType()).add("n", LongType()).add("tf", LongType())
    form = StructType().add("block", LongType()).add("id", placed.schema["id"].dataType)
    form = form.add("steps", ArrayType(IntegerType())).add("tf", ArrayType(IntegerType()))
    form = form.add("first", IntegerType()).add("words", ArrayType(word))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, texts, size = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            # A batch is cut where it would overfill the block that is being gathered.
            ends_ = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False))
            low = 0
            while low < len(batch):
                used = int(ends_[low - 1]) if low else 0
                high = min(len(batch), low + most - texts, int(np.searchsorted(ends_, used + entries - size, "right")))
                high = max(high, low + 1) if not texts else max(high, low)
                if high > low:
                    held.append(batch.slice(low, high - low))
                    texts, size = texts + high - low, size + int(ends_[high - 1]) - used
                if high < len(batch):
                    yield from _block(pa.Table.from_batches(held), number)
                    number, held, texts, size = number + 1, [], 0, 0
                low = high
        if held:
            yield from _block(pa.Table.from_batches(held), number)

    ids = placed.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("id").alias("again"))
    again = stage(ids, fresh_path(spark, "again"))
    repeated = again.limit(SMALL_IDS + 1).count()
    if not repeated:
        return placed.mapInArrow(gather, form)
    if repeated <= SMALL_IDS:
        again = F.broadcast(again)
    same = F.col("id").eqNullSafe(F.col("again"))
    several = placed.join(again, same, "left_semi")
    hashed = F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(several.count() / BLOCK_TEXTS)))).alias("_block")

    def together(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(_block(rows, -1 - key[0].as_py())))

    alone = placed.join(again, same, "left_anti").mapInArrow(gather, form)
    return alone.union(several.select("id", "terms", hashed).groupBy("_block").applyInArrow(together, form))


def _block(texts: pa.Table, number: int) -> Iterator[pa.RecordBatch]:
    """The rows of a block of texts and of its words."""
    lists = texts["terms"].combine_chunks()
    first, entries = _entries(lists)
    spelled = entries.field("term").dictionary_encode()
    order = pc.array_sort_indices(spelled.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code = rank[spelled.indices.to_numpy(zero_copy_only=False)]
    tf = entries.field("tf").to_numpy(zero_copy_only=False)
    steps = np.diff(code, prepend=0)
    begin = first[:-1][np.diff(first) > 0]
    steps[begin] = code[begin]
    starts, count = pa.array(first.astype(np.int32)), len(lists)
    ints = lambda x: pa.ListArray.from_arrays(starts, pa.array(x.astype(np.int32)))
    names = ["block", "id", "steps", "tf", "first", "words"]
    word = pa.struct([("term", pa.string()), ("n", pa.int64()), ("tf", pa.int64())])
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(count, number)), texts["id"].combine_chunks(), ints(steps), ints(tf),
         pa.nulls(count, pa.int32()), pa.nulls(count, pa.list_(word))],
        names,
    )
    size = len(order)
    own = pa.StructArray.from_arrays(
        [spelled.dictionary.take(pa.array(order)), pa.array(np.bincount(code, minlength=size)),
         pa.array(np.bincount(code, weights=tf, minlength=size).astype(np.int64))],
        ["term", "n", "tf"],
    )
    starts = np.arange(0, size, ROW_WORDS)
    edges = np.append(starts, size).astype(np.int32)
    count = len(starts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(count, number)), pa.nulls(count, texts["id"].type), pa.nulls(count, pa.list_(pa.int32())),
         pa.nulls(count, pa.list_(pa.int32())), pa.array(starts.astype(np.int32)), pa.ListArray.from_arrays(pa.array(edges), own)],
        names,
    )


def _frequent(rows: pa.Table, known: pa.Table, shared: bool) -> pa.Table:
    """``id, alone, e`` of the texts of a block: their words with frequencies, from the rarest; with
    ``shared``, ``alone`` sums the squared counts of the words that no other text has, left out of e."""
    words = rows.filter(rows["words"].is_valid()).sort_by("first")
    spelling = _entries(words["words"].combine_chunks())[1].field("term")
    texts = rows.filter(rows["steps"].is_valid())
    ids = texts["id"].combine_chunks().dictionary_encode(null_encoding="encode")
    lists = texts["steps"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    first = np.cumsum(sizes) - sizes
    code = np.cumsum(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
    before = np.concatenate([[0], code])[first]
    code -= np.repeat(before, sizes)
    df = np.zeros(len(spelling), np.int64)
    df[known["at"].to_numpy()] = known["df"].to_numpy()
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    owner = np.repeat(ids.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes)
    tf = texts["tf"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    counted = df[code] > 0
    owner, tf, code = owner[counted], tf[counted], code[counted]
    order = np.lexsort((tf, rank[code], owner))
    owner, tf, code = owner[order], tf[order], code[order]
    held = df[code] > (1 if shared else 0)
    count = len(ids.dictionary)
    alone = np.bincount(owner[~held], weights=(tf * tf)[~held], minlength=count).astype(np.int64)
    found = np.flatnonzero(np.bincount(owner, minlength=count))  # others have no counted word
    sizes = np.bincount(owner[held], minlength=count)[found]
    at = code[held]
    struct = pa.StructArray.from_arrays(
        [pa.array(df[at]), spelling.take(pa.array(at)), pa.array(tf[held])], ["df", "term", "tf"]
    )
    starts = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.table(
        {
            "id": ids.dictionary.take(pa.array(found)), "alone": pa.array(alone[found]),
            "e": pa.ListArray.from_arrays(starts, struct),
        }
    )


def tfidf(
    docs: DataFrame, id_: str, text: str, max_terms: int | None = None, once: bool = False
) -> DataFrame:
    """``id, term, w``: the vectors of ``tfidf_vectors`` in long form, not written before they are read."""
    met, weighted, _ = _met(docs, id_, text, max_terms, once, False)
    return met.select("id", F.inline(weighted)).select("id", "term", "w")


def as_vectors(weights: DataFrame) -> DataFrame:
    """Vectors from long weights ``(id, term, w)``, entries from the rarest term to the most common, as
    a written table; vectors stay as they are (those of ``tfidf_vectors`` are read from one)."""
    if "entries" in weights.columns:
        return weights
    spread = weights.groupBy("term").agg(F.count("*").alias("df"))
    entry = F.struct("df", "term", "w")
    vectors = weights.join(spread, "term").groupBy("id").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    return stage(vectors, fresh_path(weights.sparkSession, "vectors"))


def heads(vectors: DataFrame, min_sim: float) -> DataFrame:
    """``id, term, w, after, twice``: the entries of a vector before its common end, which is shorter than
    ``min_sim``; ``after`` is the squared length of what follows, ``twice`` says that the vector has a term
    more than once, as under repeated ids. Terms of one vector are left out. Sizes of weights and lengths
    are whole numbers of 1 / UNIT, rounded up."""
    batch_settings(vectors.sparkSession)
    form = StructType([vectors.schema["id"]]).add("term", StringType()).add("w", IntegerType()).add("after", IntegerType())
    form = form.add("twice", BooleanType())
    least = (min_sim - SLACK) ** 2
    units = lambda x: pa.array(np.ceil(x * UNIT).astype(np.int32))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, entries = _entries(batch.column("entries"))
            w = entries.field("w").to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
            square, after = w * w, np.zeros(len(w))
            for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
                after[low : high - 1] = np.cumsum(square[low + 1 : high][::-1])[::-1]
            df = entries.field("df").to_numpy(zero_copy_only=False)
            at = np.flatnonzero((after + square >= least) & (df > 1))
            term = entries.field("term").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            again = (term[1:] == term[:-1]) & (owner[1:] == owner[:-1])
            twice = np.bincount(owner[1:][again], minlength=len(first) - 1) > 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(owner[at])), entries.field("term").take(pa.array(at)),
                 units(np.abs(w[at])), units(after[at]), pa.array(twice[owner[at]])],
                ["id", "term", "w", "after", "twice"],
            )

    return vectors.select("id", "entries").mapInArrow(cut, form)


def _entries(column: pa.ListArray) -> tuple[np.ndarray, pa.StructArray]:
    """Where the entries of each row begin, with the end of the last, and all entries."""
    first = column.offsets.to_numpy().astype(np.int64)
    return first - first[0], column.values.slice(first[0], first[-1] - first[0])


def candidate_pairs(vectors: DataFrame, min_sim: float) -> DataFrame:
    """``a, b``, a < b: all pairs of vectors no longer than 1 that can reach ``min_sim`` > 0.

    The common end of a vector that is shorter than ``min_sim`` cannot carry a pair alone, so a pair
    must meet in an entry before it, and where it meets, what is left of both from there on must
    still be long enough. Over all entries where a pair meets, their products and the lengths of what
    is left of both after the last must reach it as well. A term with many such entries is dealt out
    as a grid of cells, blocks of it on both sides.
    """
    (pairs,) = _candidates(vectors, min_sim, math.inf)
    return pairs


def _candidates(vectors: DataFrame, min_sim: float, at_once: float) -> Iterator[DataFrame]:
    """The pairs of ``candidate_pairs`` in written parts, each of so many vectors on one side that about
    ``at_once`` meetings are followed up, in large tables as many as their entries allow; a part goes when
    the next is asked for."""
    if min_sim <= 0:
        raise ValueError("min_sim must be positive")
    spark = vectors.sparkSession
    path = fresh_path(spark, "heads")
    ranked = _stage(heads(vectors, min_sim), path)
    shared = ranked.groupBy("term").agg(F.count("*").alias("n")).where("n > 1")
    shared = _stage(shared, fresh_path(spark, "shared"))
    entries, meetings = (x or 0 for x in shared.agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2)).first())
    hot = shared.select("term", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("blocks")).where("blocks > 1")
    hot = stage(hot, fresh_path(spark, "hot"))
    if hot.limit(SMALL_IDS + 1).count() <= SMALL_IDS:
        hot = F.broadcast(hot)
    blocked = ranked.join(hot, "term", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    parts = max(1, math.ceil(meetings / max(at_once, HEAD_MEETINGS * entries)))
    before = None
    for part in range(parts):
        left = blocked.where(F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(parts)) == part).select(
            "term", F.col("id").alias("a"), F.col("w").alias("w_a"), F.col("after").alias("after_a"), F.col("twice").alias("twice_a"),
            own.alias("row"), every.alias("column"),
        )
        right = blocked.select(
            "term", F.col("id").alias("b"), F.col("w").alias("w_b"), F.col("after").alias("after_b"), F.col("twice").alias("twice_b"),
            own.alias("column"), every.alias("row"),
        )
        least = (min_sim - SLACK) ** 2 * UNIT * UNIT
        rest = lambda side: F.col(f"after_{side}") + F.col(f"w_{side}") * F.col(f"w_{side}") / UNIT
        met = left.join(right, ["term", "row", "column"]).where(
            (F.col("a") < F.col("b")) & (rest("a") * rest("b") >= least)
        )
        # Lengths only shrink along a vector, so the least of each side is that after the last meeting.
        reach = met.groupBy("a", "b").agg(
            F.sum(F.col("w_a").cast("long") * F.col("w_b")).alias("_met"),
            F.min("after_a").alias("_after_a"), F.min("after_b").alias("_after_b"),
            F.max(F.col("twice_a") | F.col("twice_b")).alias("_twice"),
        )
        most = F.col("_met") / UNIT + F.sqrt(F.col("_after_a").cast("double") * F.col("_after_b"))
        reach = reach.where((most >= (min_sim - SLACK) * UNIT) | F.col("_twice"))
        now = fresh_path(spark, "candidates")
        pairs = _stage(reach.select("a", "b"), now)
        if before is not None:
            unstage(spark, before)
        if part == parts - 1:
            unstage(spark, path)
        before = now
        yield pairs


def _stage(df: DataFrame, path: str) -> DataFrame:
    """``stage``; what the rows were shuffled through goes as soon as they are written."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        return stage(df, path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def ends(pairs: DataFrame) -> DataFrame:
    """The ids in any pair."""
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def picked_vectors(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """The vectors that occur in pairs; few ids are broadcast, so that the others are not shuffled."""
    needed = _stage(ends(pairs), fresh_path(pairs.sparkSession, "ids"))
    if needed.limit(SMALL_IDS + 1).count() <= SMALL_IDS:
        needed = F.broadcast(needed)
    return vectors.join(needed, "id", "left_semi")


def compared(
    pairs: DataFrame, rows: DataFrame, least: float | None, cell_rows: int = CELL_ROWS, rough: bool = False,
    at_once: float = math.inf, read: list[str] | None = None,
) -> list[DataFrame]:
    """``a, b, sim`` for the given pairs, in parts of about ``at_once`` pairs: dot products of ``rows(id, terms, w, twice)``, where ``least``
    is given only those that reach it. Where an end has a term ``twice``, of the entries of both with
    one term, in the order of their weights, neighbours are multiplied; ``rough`` rows keep such pairs.

    Pairs are gathered where most of their rows are needed anyhow: under the smallest id that is tied
    to an end, many small gatherings in one group. A row goes once to each group with a pair of it. A
    gathering of many rows is a grid of cells, blocks of its rows on both sides. ``read`` gets the folders
    that the result is read from.
    """
    spark = pairs.sparkSession
    batch_settings(spark)
    paths = [fresh_path(spark, name) for name in ("named", "crowd", "placed")]
    side = lambda x, y: F.struct(F.col(x).alias("id"), F.col(y).alias("other"))
    near = pairs.select(F.inline(F.array(side("a", "b"), side("b", "a")))).groupBy("id").agg(
        F.min("other").alias("other")
    ).select("id", F.least("id", "other").alias("low"))
    named = (
        pairs.select("a", "b")
        .join(near.select(F.col("id").alias("a"), F.col("low").alias("low_a")), "a")
        .join(near.select(F.col("id").alias("b"), F.col("low").alias("low_b")), "b")
        .select("a", "b", F.least("low_a", "low_b").alias("label"))
    )
    named = _stage(named, paths[0])
    ends_of = named.select("label", F.explode(F.array("a", "b")).alias("id")).distinct()
    tally = ends_of.select("label", F.lit(1).alias("n"), F.lit(0).alias("pairs")).union(
        named.select("label", F.lit(0), F.lit(1))
    )
    crowd = tally.groupBy("label").agg(F.sum("n").alias("n"), F.sum("pairs").alias("pairs"))
    crowd = _stage(crowd, paths[1])
    rows_, pairs_ = (x or 0 for x in crowd.agg(F.sum("n"), F.sum("pairs")).first())
    groups = max(1, math.ceil(rows_ / cell_rows), math.ceil(pairs_ / CELL_PAIRS))
    parts = F.ceil(F.greatest(F.col("n") / cell_rows, F.sqrt(F.col("pairs") / CELL_PAIRS))).alias("blocks")
    large = crowd.select("label", parts).where("blocks > 1")
    block = lambda end: F.pmod(F.xxhash64(end), F.col("blocks"))
    cell = F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("label"), F.lit(groups))).otherwise(
        F.xxhash64("label", block("a"), block("b"))
    )
    placed = _stage(named.join(large, "label", "left").select(cell.alias("cell"), "a", "b"), paths[2])
    for path in paths[:2]:
        unstage(spark, path)
    if read is not None:
        read.append(paths[2])
    kind = pairs.schema["a"].dataType
    form = StructType().add("a", kind).add("b", kind).add("sim", DoubleType())

    def meet(some: pa.Table, vectors: pa.Table) -> pa.Table:
        return _dots(some, vectors, least, rough)

    parts = max(1, math.ceil(pairs_ / at_once))
    found = []
    for part in range(parts):
        own = placed.where(F.pmod(F.xxhash64(F.lit("part"), "cell"), F.lit(parts)) == part) if parts > 1 else placed
        needed = own.select(F.col("cell").alias("into"), F.explode(F.array("a", "b")).alias("id")).distinct()
        shipped = rows.join(needed, "id").select("into", "id", "terms", "w", "twice")
        found.append(own.groupBy("cell").cogroup(shipped.groupBy("into")).applyInArrow(meet, form))
    return found


def _dots(pairs: pa.Table, vectors: pa.Table, least: float | None, rough: bool) -> pa.Table:
    """The dot products of pairs whose vectors are at hand; terms are numbers or words."""
    ids = vectors["id"].combine_chunks()
    lists, weights = vectors["terms"].combine_chunks(), vectors["w"].combine_chunks()
    codes = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    w = weights.flatten().to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))]).astype(np.int64)
    at_a = pc.index_in(pairs["a"].combine_chunks(), value_set=ids)
    at_b = pc.index_in(pairs["b"].combine_chunks(), value_set=ids)
    known = pc.and_(at_a.is_valid(), at_b.is_valid())
    pairs = pairs.filter(known)
    a, b = (x.filter(known).to_numpy(zero_copy_only=False).astype(np.int64) for x in (at_a, at_b))
    order = np.argsort(a, kind="stable")
    size, sim = np.diff(first), np.zeros(len(a))
    dense = np.zeros(int(codes.max()) + 1 if len(codes) else 1)
    turns = np.flatnonzero(np.diff(a[order], prepend=-1))
    for low, high in zip(turns.tolist(), [*turns[1:].tolist(), len(order)]):
        own = slice(first[a[order[low]]], first[a[order[low]] + 1])
        np.add.at(dense, codes[own], w[own])
        step = max(1, int(CELL_ENTRIES // max(1, size[b[order[low:high]]].max())))
        for start in range(low, high, step):
            rows = order[start : min(start + step, high)]
            of = b[rows]
            each = np.repeat(np.arange(len(of)), size[of])
            place = np.arange(len(each)) + (first[of] - np.cumsum(size[of]) + size[of])[each]
            sim[rows] = np.bincount(each, weights=dense[codes[place]] * w[place], minlength=len(of))
        dense[codes[own]] = 0
    twice = vectors["twice"].to_numpy()
    many = twice[a] | twice[b]
    for k in [] if rough else np.flatnonzero(many).tolist():
        ends_ = slice(first[a[k]], first[a[k] + 1]), slice(first[b[k]], first[b[k] + 1])
        term, weight = (np.concatenate([x[e] for e in ends_]) for x in (codes, w))
        turn = np.lexsort((weight, term))
        term, weight = term[turn], weight[turn]
        sim[k] = (weight[1:] * weight[:-1])[term[1:] == term[:-1]].sum()
    kept = np.arange(len(sim)) if least is None else np.flatnonzero((sim >= least) | (many & rough))
    out = pairs.take(pa.array(kept))
    return pa.table({"a": out["a"], "b": out["b"], "sim": pa.array(sim[kept])})


def _twice() -> Column:
    return (F.size(F.array_distinct("entries.term")) < F.size("entries")).alias("twice")


def outlines(vectors: DataFrame) -> DataFrame:
    """``id, terms, w, twice``: for every vector 15-bit hashes of its terms and the sizes of its weights,
    rounded up to 16 bits. Their dot products are never below those of the vectors."""
    hashes = F.transform("entries", lambda e: F.xxhash64(e["term"]).bitwiseAND(F.lit(0x7FFF)).cast("short"))
    sizes = F.transform("entries", lambda e: F.ceil(F.abs(e["w"]) * UNIT).cast("short"))
    return vectors.select("id", hashes.alias("terms"), sizes.alias("w"), _twice())


def near_pairs(pairs: DataFrame, sketched: DataFrame, least: float) -> DataFrame:
    """The written pairs whose outlines reach ``least``, so that whole vectors are moved for few others.
    Outlines are moved for some pairs at a time."""
    spark, read = pairs.sparkSession, []
    parts = compared(pairs, sketched, least * UNIT * UNIT, 3 * CELL_ROWS, rough=True, at_once=MOVED_PAIRS, read=read)
    near = [_stage(part.select("a", "b"), fresh_path(spark, "near")) for part in parts]
    for path in read:
        unstage(spark, path)
    return reduce(DataFrame.union, near)


def dot_products(pairs: DataFrame, vectors: DataFrame, least: float | None = None) -> DataFrame:
    """``a, b, sim`` for the given pairs; with ``least``, those that reach it."""
    whole = picked_vectors(pairs, vectors).select(
        "id", F.col("entries.term").alias("terms"), F.col("entries.w").alias("w"), _twice()
    )
    return compared(pairs, whole, least)[0]


def similar_pairs(vectors: DataFrame, min_sim: float) -> DataFrame:
    """All pairs ``(a, b, sim)``, a < b, of vectors no longer than 1 whose dot product reaches
    ``min_sim`` > 0. Exact. ``vectors`` is read several times and should be a written table.

    Candidates are found and thinned out in parts, so that the disk holds those of one part.
    """
    least, spark = min_sim - SLACK, vectors.sparkSession
    path = fresh_path(spark, "outlines")
    sketched = _stage(outlines(vectors), path)
    near = [near_pairs(pairs, sketched, least) for pairs in _candidates(vectors, min_sim, MEETINGS)]
    unstage(spark, path)
    return dot_products(reduce(DataFrame.union, near), vectors, least)


def cosine_pairs(weights: DataFrame, min_sim: float) -> DataFrame:
    """Pairs of unit vectors (see ``as_vectors``) with at least this cosine similarity.

    Identical vectors should be represented once: see ``vector_groups``.
    """
    kept = as_vectors(weights)
    return similar_pairs(kept, min_sim).where(F.col("sim") >= min_sim)


def vector_groups(vectors: DataFrame) -> DataFrame:
    """``(id, same_as, copies)``: texts with equal vectors share the smallest id among them.

    Copies are linked to one representative instead of to each other.
    """
    entries = F.transform("entries", lambda e: F.struct(e["term"], F.round(e["w"], 12)))
    signature = F.sha2(F.to_json(entries), 256)
    if "alone" in vectors.columns:  # a term that no other text has sets a text apart
        signature = F.when(F.col("alone"), F.col("id").cast("string")).otherwise(signature)
    signed = vectors.select("id", signature.alias("signature"))
    shared = signed.groupBy("signature").agg(
        F.min("id").alias("same_as"), F.count("*").alias("copies")
    )
    return signed.join(shared, "signature").drop("signature")


def linkage_clusters(weights: DataFrame, threshold: float) -> DataFrame:
    """Average-linkage clusters of unit vectors (see ``as_vectors``) cut at a cosine distance: ``(id, cluster)``.

    The mean similarity of two clusters is the dot product of their mean vectors, so a cluster is
    one sparse vector and its size. Pairs of clusters above the cut are found once and kept. In each
    round every cluster looks up its most similar partner, and pairs that choose each other merge;
    for average linkage this gives the same tree as merging one closest pair at a time. A merged
    cluster's similarity to another is the mean of its parts', so it can only pass the cut where one
    part's did: those pairs alone are computed again, all others carry over. The closest pair of all
    merges in every round, so rounds end when no pair is left. Equal similarities are ordered by a
    hash of the pair; a cluster is named by the smallest id in it. Vectors that pairs tie together, where
    they are few, have their rounds in one task; only what is left has rounds of jobs.
    """
    return clusters_above(as_vectors(weights), threshold)


def clusters_above(vectors: DataFrame, threshold: float, sims: DataFrame | None = None) -> DataFrame:
    """``linkage_clusters``; ``sims`` are the similar pairs of all vectors above the cut, where they are
    known already."""
    spark = vectors.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        return _stage(df, fresh_path(spark, name))

    groups = kept(vector_groups(vectors), "groups")
    members = groups.select("id", F.col("same_as").alias("cluster"))
    sizes = groups.groupBy(F.col("same_as").alias("id")).agg(F.max("copies").alias("size"))
    clusters = vectors.join(sizes, "id")
    min_sim = 1.0 - threshold
    cut = round(min_sim, 12)
    above = F.round("sim", 12) > F.lit(cut)
    if sims is None:
        clusters = kept(clusters, "clusters")
        sims = similar_pairs(clusters, max(min_sim, SLACK))
    else:
        own = clusters.select("id")
        sims = sims.join(own.withColumnRenamed("id", "a"), "a", "left_semi").join(own.withColumnRenamed("id", "b"), "b", "left_semi")
    pairs = sims.select("a", "b", F.round("sim", 12).alias("sim"))
    pairs = kept(pairs.where(above), "pairs")
    clusters = kept(picked_vectors(pairs, clusters), "clusters")
    known = isinstance(vectors.schema["id"].dataType, (IntegralType, StringType))
    tied = tied_together(pairs) if known and cut > 0 else None
    if tied is not None:
        merged, large = merged_at_once(tied, clusters, cut)
        merged = kept(merged, "merged")
        named = merged.select(F.col("id").alias("cluster"), F.col("cluster").alias("_to"))
        members = members.join(named, "cluster", "left").select("id", F.coalesce("_to", "cluster").alias("cluster"))
        members = kept(members, "members")
        pairs = kept(pairs.join(large.withColumnRenamed("id", "a"), "a", "left_semi"), "pairs")
        if pairs.isEmpty():
            return members
        clusters = kept(clusters.join(large, "id", "left_semi"), "clusters")
    for number in itertools.count(1):
        ranked = pairs.withColumn("rank", F.struct("sim", F.xxhash64("a", "b")))
        choices = ranked.select(F.col("a").alias("own"), F.col("b").alias("other"), "rank").union(
            ranked.select(F.col("b"), F.col("a"), "rank")
        )
        best = choices.groupBy("own").agg(F.max_by("other", "rank").alias("other"))
        back = best.select(F.col("own").alias("other"), F.col("other").alias("own"))
        merges = kept(
            best.join(back, ["own", "other"])
            .where(F.col("own") < F.col("other"))
            .select(F.col("other").alias("_from"), F.col("own").alias("_into")),
            "merges",
        )
        if merges.isEmpty():
            return members
        members = _renamed(members, "cluster", merges)
        if number % 5 == 0:
            members = kept(members, "members")
        changed = merges.union(merges.select(F.col("_into").alias("_from"), "_into"))

        at_a = changed.select(F.col("_from").alias("a"), F.col("_into").alias("new_a"))
        at_b = changed.select(F.col("_from").alias("b"), F.col("_into").alias("new_b"))
        x, y = F.coalesce("new_a", "a"), F.coalesce("new_b", "b")
        moved = pairs.join(at_a, "a", "left").join(at_b, "b", "left").select(
            F.least(x, y).alias("a"), F.greatest(x, y).alias("b"),
            F.when(F.col("new_a").isNull() & F.col("new_b").isNull(), F.col("sim")).alias("sim"),
        )
        # Two pairs that become one are both without a similarity, as one end has changed.
        moved = kept(moved.where(F.col("a") != F.col("b")).distinct(), "moved")

        parts = clusters.join(changed, clusters["id"] == changed["_from"])
        totals = parts.groupBy("_into").agg(F.sum("size").alias("total"))
        terms = parts.select("_into", "size", F.inline("entries")).groupBy("_into", "df", "term").agg(
            F.sum(F.col("w") * F.col("size")).alias("mass")
        )
        entry = F.struct("df", "term", (F.col("mass") / F.col("total")).alias("w"))
        joined = terms.join(totals, "_into").groupBy(F.col("_into").alias("id")).agg(
            F.sort_array(F.collect_list(entry)).alias("entries"), F.max("total").alias("size")
        )
        rest = clusters.join(changed.select(F.col("_from").alias("id")), "id", "left_anti")
        clusters = rest.select("id", "entries", "size").unionByName(joined)
        clusters = kept(clusters.join(ends(moved), "id", "left_semi"), "clusters")
        found = dot_products(moved.where("sim IS NULL").select("a", "b"), clusters)
        found = found.select("a", "b", F.round("sim", 12).alias("sim")).where(above)
        pairs = kept(moved.where("sim IS NOT NULL").union(found), "pairs")


def tied_together(pairs: DataFrame) -> DataFrame | None:
    """``id, tie`` for the ends of pairs, the same ``tie`` for all that chains of pairs connect; None where
    these are too many for one task to find."""
    spark = pairs.sparkSession
    form = StructType([pairs.schema["a"], pairs.schema["b"]])

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        both = pa.chunked_array([*table["a"].chunks, *table["b"].chunks]).combine_chunks().dictionary_encode()
        code = both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        root = _roots(code[: len(table)], code[len(table) :], len(both.dictionary))
        yield pa.RecordBatch.from_arrays([both.dictionary, both.dictionary.take(pa.array(root))], ["a", "b"])

    links = stage(pairs.select("a", "b").mapInArrow(tie, form), fresh_path(spark, "links"))
    if links.limit(TIED_LINKS + 1).count() > TIED_LINKS:
        return None
    ties = links.coalesce(1).mapInArrow(tie, form)
    return stage(ties.select(F.col("a").alias("id"), F.col("b").alias("tie")), fresh_path(spark, "ties"))


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the same node for all that the links from a to b connect."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]


def merged_at_once(tied: DataFrame, clusters: DataFrame, cut: float) -> tuple[DataFrame, DataFrame]:
    """``id, cluster`` of the clusters that are tied to few others, all their rounds in one task, and the
    ids of the rest: ties of over ``TIE_ROWS`` vectors and those with a term twice in one."""
    spark = tied.sparkSession
    batch_settings(spark)
    crowd = tied.join(clusters.select("id", _twice()), "id").groupBy("tie").agg(
        F.count("*").alias("n"), F.max("twice").alias("twice")
    )
    few = (F.col("n") <= TIE_ROWS) & ~F.col("twice")
    sized = stage(tied.join(crowd, "tie").select("id", "tie", few.alias("few")), fresh_path(spark, "sized"))
    groups = max(1, math.ceil(sized.where("few").count() / TIE_ROWS))
    group = F.pmod(F.xxhash64("tie"), F.lit(groups)).alias("group")
    rows = clusters.join(sized.where("few").select("id", "tie", group), "id").select(
        "group", "tie", "id", "size", F.col("entries.term").alias("terms"), F.col("entries.w").alias("w")
    )
    kind = clusters.schema["id"].dataType
    form = StructType().add("id", kind).add("cluster", kind)

    def merge(rows: pa.Table) -> pa.Table:
        return _merged(rows.combine_chunks(), cut)

    return rows.groupBy("group").applyInArrow(merge, form), sized.where("NOT few").select("id")


def _merged(rows: pa.Table, cut: float) -> pa.Table:
    """The clusters of the vectors of some ties."""
    tie = rows["tie"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    ids = rows["id"].combine_chunks()
    order = np.lexsort((np.argsort(pc.array_sort_indices(ids).to_numpy()), tie))  # ids of a tie in their order
    ids, size = ids.take(pa.array(order)), rows["size"].to_numpy().astype(np.float64)[order]
    lists = rows["terms"].combine_chunks()
    first = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))]).astype(np.int64)
    code = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    w = rows["w"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    into = np.arange(len(ids))
    turns = np.flatnonzero(np.diff(tie[order], prepend=-1))
    dense = np.zeros(int(code.max()) + 1 if len(code) else 1)
    for low, high in zip(turns.tolist(), [*turns[1:].tolist(), len(ids)]):
        own = order[low:high]
        lengths = first[own + 1] - first[own]
        each = np.repeat(np.arange(len(own)), lengths)
        place = np.arange(len(each)) + (first[own] - np.cumsum(lengths) + lengths)[each]
        codes, weights, total = code[place], w[place] * size[low:high][each], np.zeros((len(own), len(own)))
        ends_ = np.cumsum(lengths)
        for k in range(len(own)):
            mine = slice(ends_[k] - lengths[k], ends_[k])
            dense[codes[mine]] = weights[mine]
            total[k] = np.bincount(each, weights=dense[codes] * weights, minlength=len(own))
            dense[codes[mine]] = 0
        total = np.maximum(total, total.T)
        into[low:high] = low + _linked(total, size[low:high], cut, lambda i, j, low=low: _pair_hash(ids[low + i], ids[low + j]))
    return pa.table({"id": ids, "cluster": ids.take(pa.array(into))})


def _linked(total: np.ndarray, size: np.ndarray, cut: float, order_of: Callable[[int, int], int]) -> np.ndarray:
    """For each row the first of its cluster, by rounds of merging rows that choose each other; ``total``
    holds the products of the vectors times their sizes, equal similarities go by ``order_of`` the pair."""
    size, into = size.copy(), np.arange(len(size))
    sim = np.round(total / (size[:, None] * size), 12)
    np.fill_diagonal(sim, -1.0)
    while True:
        best, most = sim.argmax(axis=1), sim.max(axis=1)
        asks = np.flatnonzero(most > cut)
        if not len(asks):
            return into
        ties = (sim[asks] == most[asks][:, None]).sum(axis=1) > 1
        for i in asks[ties].tolist():
            best[i] = max(np.flatnonzero(sim[i] == most[i]).tolist(), key=lambda j: order_of(min(i, j), max(i, j)))
        low = asks[(best[best[asks]] == asks) & (asks < best[asks]) & (most[best[asks]] > cut)]
        high = best[low]
        if not len(low):
            return into
        total[low] += total[high]
        total[:, low] += total[:, high]
        size[low] += size[high]
        renamed = np.arange(len(into))
        renamed[high] = low
        into = renamed[into]
        fresh = np.round(total[low] / (size[low][:, None] * size), 12)
        sim[low], sim[:, low] = fresh, fresh.T
        sim[high], sim[:, high] = -1.0, -1.0
        gone = np.setdiff1d(np.arange(len(into)), into)
        sim[:, gone], sim[gone] = -1.0, -1.0
        np.fill_diagonal(sim, -1.0)


def _pair_hash(*ids: pa.Scalar) -> int:
    """``xxhash64`` of Spark for a pair of ids."""
    seed = 42
    for x in ids:
        kind, value = x.type, x.as_py()
        if pa.types.is_integer(kind):
            data = value.to_bytes(8 if kind.bit_width == 64 else 4, "little", signed=True)
        else:
            data = value.encode()
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def _renamed(df: DataFrame, column: str, merges: DataFrame) -> DataFrame:
    joined = df.join(merges, F.col(column) == F.col("_from"), "left")
    return joined.withColumn(column, F.coalesce("_into", column)).drop("_from", "_into")


def lone_or_paired(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids that are in no pair, or in one with an id that is in no other."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    degree = both.groupBy("id").agg(F.count("*").alias("n"), F.min("other").alias("other"))
    partner = degree.select(F.col("id").alias("other"), F.col("n").alias("m"))
    crowded = degree.join(partner, "other", "left").where("n > 1 OR m > 1").select("id")
    return ids.join(crowded, "id", "left_anti")


def cluster_texts(
    df: DataFrame, text: str, threshold: float, to: str, max_terms: int | None = None
) -> DataFrame:
    """Cluster the distinct texts of a column and write each row's cluster.

    A text without any counted word is its own cluster.
    """
    distinct = df.select(text).where(F.col(text).isNotNull()).distinct()
    vectors = tfidf_vectors(distinct, text, text, max_terms, shared=True)
    named = linkage_clusters(vectors, threshold).select(
        F.col("id").alias(text), F.col("cluster").alias(to)
    )
    return df.join(named, text, "left").withColumn(to, F.coalesce(to, text))


def mean_vector(df: DataFrame, key: str, vector: str, weight: Column | None = None, to: str = "mean"):
    """Mean of array columns per key, optionally weighted; sums are merged on the map side."""
    as_vector = array_to_vector(F.col(vector).cast("array<double>"))
    prepared = df.withColumns({"_v": as_vector, "_w": F.lit(1.0) if weight is None else weight})
    mean = Summarizer.mean(F.col("_v"), F.col("_w").cast("double"))
    return prepared.groupBy(key).agg(vector_to_array(mean).alias(to))


def session_vectors(
    events: DataFrame, vectors: DataFrame, key: str, product: str, vector: str, size: int,
    to: str = "mean",
) -> DataFrame:
    """Mean product vector per session; products without a vector count as zero vectors.

    Vectors join one row per (session, product), not every event.
    """
    counted = events.groupBy(key, product).agg(F.count("*").alias("_n"))
    joined = counted.join(vectors.select(product, vector), product, "left")
    zero = F.array_repeat(F.lit(0.0).cast("float"), size)
    filled = joined.withColumn(vector, F.coalesce(F.col(vector), zero))
    return mean_vector(filled, key, vector, F.col("_n"), to)
