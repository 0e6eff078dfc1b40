"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A signature has 32 symbols of 16 bits in 8 chunks of 4. Two signatures that differ in 15 symbols or
fewer have, by the pigeonhole principle, a chunk with at most one difference (8 * 2 > 15). Every
chunk is therefore indexed four times, each time without one of its symbols: all pairs within the
threshold share a key. Documents of similarity 0.75 differ in 8 of 32 symbols on average, and one
chunk of them all but surely agrees in three symbols; pairs are confirmed on whole shingle sets.

Documents with equal sets are one node. A first round ties every node to the most central one of
each key, the one that shares most keys with others; only keys whose nodes are still in different
components go to a second round. There a node leaves for good if over a quarter of its shingles occur
in no other node of the round: it cannot reach the similarity with any. The rest of a key meet with
their whole sets: an index of the shingles gives every node of a smaller component its exact overlap
with all others, and one link for each component it reaches goes on. Keys with many shingles are
split into blocks that meet two by two; nothing is emitted pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.arrays import (
    blocks,
    held_for,
    lists,
    mixed,
    odd_numbers,
    span_list,
    word_hashes,
    word_spans,
)
from sessionloom.llm.storage import batch_settings, cut_lineage, store

SHINGLE = 5
SYMBOLS, CHUNKS, WIDTH = 32, 8, 16
PER_CHUNK = SYMBOLS // CHUNKS
MOST_DIFFERENT = 2 * CHUNKS - 1
SHARE = 75  # percent
HOT_BUCKET = 20_000  # nodes of a key beyond which the key is refined by a second chunk
BLOCK_SHINGLES = 1_000_000  # of a block of a key
BROADCAST_ROWS = 1_000_000


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text; a shorter text is one shingle."""
    odd = odd_numbers(k, 5)
    if len(words) >= k:
        runs = len(words) - k + 1
        total = words[:runs] * odd[0]
        for i in range(1, k):
            total += words[i : i + runs] * odd[i]
        total = mixed(total, 1)
    else:
        total = np.zeros(0, np.uint64)
    sets = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
        if high - low >= k:
            sets.append(np.unique(total[low : high - k + 1]))
        elif high > low:
            sets.append(np.array([xxhash.xxh3_64_intdigest(words[low:high].tobytes(), 3)], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signature(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The chunks of a text's signature as 64-bit numbers, 16 bits of each MinHash."""
    least = np.full(len(factors), 2**64 - 1, np.uint64)
    for low in range(0, len(shingles), 4096):
        some = shingles[low : low + 4096]
        least = np.minimum(least, (some * factors[:, None] + shifts[:, None]).min(axis=1))
    return np.ascontiguousarray(mixed(least, 2).astype(np.uint16)).view(np.int64)


def sketches(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, and for texts with words a digest of the set and the signature chunks."""
    batch_settings(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_for("near duplicates")
        factors, shifts = odd_numbers(SYMBOLS, 21), odd_numbers(SYMBOLS, 22)
        for batch in batches:
            for low, high, data, edges in blocks(batch.column("text")):
                starts, ends, first = word_spans(data, edges)
                sets = shingle_hashes(word_hashes(data, starts, ends), first)
                chunks = [signature(s, factors, shifts) if len(s) else None for s in sets]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, high - low),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(chunks, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "digest", "chunks"],
                )

    return rows.mapInArrow(sketch, "doc_id long, n_shingles long, digest binary, chunks array<long>")


def shingle_sets(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the sorted distinct shingle hashes of its text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_for("near duplicates")
        for batch in batches:
            for low, high, data, edges in blocks(batch.column("text"), 1 << 20):
                starts, ends, first = word_spans(data, edges)
                sets = shingle_hashes(word_hashes(data, starts, ends), first)
                place = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), lists(flat, place, pa.int64())],
                    ["doc_id", "shingles"],
                )

    return rows.mapInArrow(build, "doc_id long, shingles array<long>")


def masks(symbols: int) -> list[tuple[tuple[int, ...], int]]:
    """(left-out places, mask of the others) for each way to leave ``symbols`` of a chunk out."""
    import itertools

    out = []
    for places in itertools.combinations(range(PER_CHUNK), symbols):
        mask = (1 << 64) - 1
        for p in places:
            mask &= ~(0xFFFF << (16 * p))
        out.append((places, mask - (1 << 64) if mask >= 1 << 63 else mask))
    return out


def differences(a: Column, b: Column) -> Column:
    """Number of symbols in which two signatures differ."""
    total = F.lit(0)
    for c in range(CHUNKS):
        x = a[c].bitwiseXOR(b[c])
        for p in range(PER_CHUNK):
            symbol = F.shiftrightunsigned(x, 16 * p).bitwiseAND(F.lit(0xFFFF))
            total = total + F.when(symbol != 0, 1).otherwise(0)
    return total


def near(a: str, b: str) -> Column:
    """Signatures within the threshold, and sizes that allow the wanted similarity."""
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (
        (100 * F.least(x, y) >= SHARE * F.greatest(x, y))
        & (differences(F.col(f"{a}.chunks"), F.col(f"{b}.chunks")) <= MOST_DIFFERENT)
    )


def index_keys(chunks: Column) -> Column:
    """The 32 keys of a signature: slot (chunk and left-out symbol) and the symbols that remain."""
    return F.array(
        *[
            F.struct(
                F.lit(c * PER_CHUNK + i).cast("byte").alias("slot"),
                chunks[c].bitwiseAND(F.lit(mask)).alias("value"),
            )
            for c in range(CHUNKS)
            for i, (_, mask) in enumerate(masks(1))
        ]
    )


def finer_keys(slot: Column, chunks: Column) -> Column:
    """Second keys within a slot: of the other 7 chunks one differs in 2 symbols at most (7 * 3 > 15)."""
    keys = [
        F.struct(
            F.lit(c * 6 + i).cast("byte").alias("slot2"), chunks[c].bitwiseAND(F.lit(mask)).alias("value2")
        )
        for c in range(CHUNKS)
        for i, (_, mask) in enumerate(masks(2))
    ]
    own = F.floor(slot / PER_CHUNK)
    return F.filter(F.array(*keys), lambda k: F.floor(k["slot2"] / 6) != own)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of the links (a, b): the smallest node that each reaches.

    Every node is tied in turn to the smallest neighbour of its larger ones and of its smaller ones,
    until the links are stars; written to the shared folder after each round.
    """
    edges = cut_lineage(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    state = mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
        )
        edges = cut_lineage(small.where("u <> v").distinct())
        now = mark(edges)
        if now == state:
            break
        state = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast rows of two numbers at most where there are few; a shuffled join beyond."""
    return F.broadcast(df) if df.count() <= rows else df


def sets_of(nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Stored shingle sets of the documents named by the column ``node``."""
    ids = cut_lineage(nodes.select(F.col("node").alias("doc_id")).distinct())
    return store(shingle_sets(docs.join(checked_broadcast(ids), "doc_id", "left_semi"), text), "shingles")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose whole shingle sets have the wanted similarity."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    every = F.size("x") + F.size("y") - common
    return (
        pairs.join(left, "a").join(right, "b")
        .where((100 * common >= SHARE * every) & (every > 0)).select("a", "b").distinct()
    )


def both_sides(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def sharing_counts(sets: DataFrame) -> DataFrame:
    """(node, shared): how many shingles of each node occur in another node too."""
    lone = (
        sets.select("doc_id", F.explode("shingles").alias("s")).groupBy("s")
        .agg(F.count("*").alias("_n"), F.min("doc_id").alias("node")).where("_n = 1")
        .groupBy("node").agg(F.count("*").alias("_lone"))
    )
    sizes = sets.groupBy(F.col("doc_id").alias("node")).agg(F.max(F.size("shingles")).alias("_size"))
    return sizes.join(lone, "node", "left").select(
        "node", (F.col("_size") - F.coalesce("_lone", F.lit(0))).alias("shared")
    )


def links_across(
    nodes: np.ndarray, parts: np.ndarray, flat: np.ndarray, first: np.ndarray
) -> list[tuple[int, int]]:
    """Links between components among nodes with whole shingle sets: for each node of all components
    but the largest, one for every other component in reach. Components that were linked count as
    one from then on."""
    sizes = np.diff(first)
    _, shingle = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(nodes)), sizes)
    order = np.argsort(shingle, kind="stable")
    holders = owner[order]
    count = np.bincount(shingle)
    place = np.cumsum(count) - count
    part = np.unique(parts, return_inverse=True)[1]
    crowd = np.bincount(part)
    found = []
    for i in np.flatnonzero(part != crowd.argmax()):
        mine = shingle[first[i] : first[i + 1]]
        mine = mine[count[mine] > 1]
        if 100 * len(mine) < SHARE * sizes[i]:
            continue
        common = np.bincount(holders[span_list(place[mine], count[mine])], minlength=len(nodes))
        near_by = (100 * common >= SHARE * (sizes + sizes[i] - common)) & (part != part[i])
        for other in np.unique(part[near_by]):
            j = int(np.flatnonzero(near_by & (part == other))[0])
            found.append((int(min(nodes[i], nodes[j])), int(max(nodes[i], nodes[j]))))
            part[part == other] = part[i]
            near_by &= part != part[i]
    return found


def meetings(rows: DataFrame, sets: DataFrame, block_shingles: int) -> DataFrame:
    """Confirmed links (a, b) across components among the nodes of every key."""
    keys = ["slot", "value", "slot2", "value2"]
    crowds = rows.groupBy(*keys).agg(F.sum("n").alias("_all"), F.min("component").alias("_low"), F.max("component").alias("_high"))
    split = crowds.where("_low <> _high").select(*keys, F.ceil(F.col("_all") / block_shingles).cast("int").alias("_blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    blocked = (
        rows.join(split, keys).withColumn("_own", own).withColumn("_other", other)
        .select(
            *keys, F.least("_own", "_other").alias("x"), F.greatest("_own", "_other").alias("y"), "node", "component"
        )
    )

    def meet(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        column = group.column("shingles").combine_chunks()
        first = column.offsets.to_numpy()
        links = links_across(
            group.column("node").to_numpy(), group.column("component").to_numpy(),
            column.values.to_numpy(zero_copy_only=False)[first[0] : first[-1]], first - first[0],
        )
        return pa.table(
            {"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())}
        )

    full = blocked.join(sets.select(F.col("doc_id").alias("node"), "shingles"), "node")
    return full.groupBy(*keys, "x", "y").applyInArrow(meet, "a long, b long").distinct()


def near_groups(
    docs: DataFrame, text: str = "text", hot_bucket: int = HOT_BUCKET, block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    component_id is the smallest doc_id that links reach, kept is doc_id = component_id. A text
    without words has no shingles and no links. Rows with equal doc_id are one document: what any of
    their texts is linked with, all are. A null doc_id can't name a group: such rows are not linked,
    have a null component_id and are kept.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias(text))
    rows = store(sketches(docs, text), "sketches")
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("digest", F.col("n_shingles").alias("n"), "chunks").agg(F.min("doc_id").alias("node"))
    nodes = store(classes.select("node", "n", "chunks", "digest"), "nodes")
    member = (
        full.select("doc_id", "digest").join(nodes.select("digest", "node"), "digest").select("doc_id", "node").distinct()
    )
    member = store(member, "members")
    home = member.groupBy("doc_id").agg(F.min("node").alias("home"), F.max("node").alias("_far"))
    split = home.where("home <> _far").select("doc_id", "home")
    same_row = member.join(split, "doc_id").where("node <> home").select(F.col("home").alias("a"), F.col("node").alias("b"))

    slim = nodes.select("node", "n", "chunks")
    keys = slim.select("node", F.inline(index_keys(F.col("chunks"))))
    crowds = keys.groupBy("slot", "value").agg(F.count("*").alias("crowd")).where("crowd > 1")
    shared = store(keys.join(crowds, ["slot", "value"]), "keys")
    central = shared.groupBy("node").agg(F.sum("crowd").alias("_weight"))
    heads = (
        shared.join(central, "node").groupBy("slot", "value")
        .agg(F.max(F.struct("_weight", (-F.col("node")).alias("_node"))).alias("_head"))
        .select("slot", "value", (-F.col("_head._node")).alias("head"))
    )
    star = (
        shared.join(heads, ["slot", "value"]).where("node <> head")
        .select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct()
    )
    p = slim.select(F.struct("node", "n", "chunks").alias("p"))
    q = slim.select(F.struct("node", "n", "chunks").alias("q"))
    star = cut_lineage(
        star.join(p, F.col("a") == F.col("p.node")).join(q, F.col("b") == F.col("q.node"))
        .where(near("p", "q")).select("a", "b").distinct()
    )
    first = cut_lineage(confirmed(star, sets_of(both_sides(star), docs, text)).union(same_row).distinct())
    grouped = components(first)

    def still_mixed(rows: DataFrame) -> DataFrame:
        kinds = (
            rows.groupBy("slot", "value")
            .agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.count("*").alias("_rows"))
            .where("_low <> _high").select("slot", "value", "_rows")
        )
        return rows.join(kinds, ["slot", "value"])

    placed = shared.join(grouped, "node", "left").select(
        "slot", "value", "node", F.coalesce("component", "node").alias("component")
    )
    open_rows = store(still_mixed(placed).drop("_rows"), "mixed")
    sets = sets_of(open_rows, docs, text)
    able = sharing_counts(sets).join(slim, "node").where(100 * F.col("shared") >= SHARE * F.col("n"))
    open_rows = still_mixed(open_rows.join(able, "node"))
    whole = ["slot", "value", "node", "component", "n", "_rows"]
    calm = open_rows.where(F.col("_rows") <= hot_bucket).select(
        *whole, F.lit(-1).cast("byte").alias("slot2"), F.lit(0).cast("long").alias("value2")
    )
    hot = open_rows.where(F.col("_rows") > hot_bucket).select(
        *whole, F.inline(finer_keys(F.col("slot"), F.col("chunks")))
    )
    pairs = cut_lineage(meetings(calm.unionByName(hot), sets, block_shingles))
    if pairs.isEmpty():
        final = grouped
    else:
        final = components(first.union(pairs))
    found = home.join(final, home["home"] == final["node"], "left").select(
        "doc_id", F.coalesce("component", "home").alias("_c")
    )
    lowest = found.groupBy("_c").agg(F.min("doc_id").alias("_least"))
    named = found.join(lowest, "_c").select(F.col("doc_id").alias("_id"), F.col("_least").alias("_component"))
    out = rows.select("doc_id", "n_shingles").join(named, F.col("doc_id") == F.col("_id"), "left")
    component = F.coalesce("_component", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near-duplicates the document with the smallest
    doc_id, and of rows with that doc_id one."""
    spark = docs.sparkSession
    groups = near_groups(docs, text)
    gone = cut_lineage(groups.where("NOT kept").select("doc_id").distinct())
    repeated = cut_lineage(
        groups.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    )
    left = docs.join(checked_broadcast(gone), "doc_id", "left_anti")
    if repeated.isEmpty():
        return left.select(*docs.columns)
    once = checked_broadcast(repeated)
    many = left.join(once, "doc_id", "left_semi").select(*docs.columns)
    least = many.groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    return left.join(once, "doc_id", "left_anti").select(*docs.columns).unionByName(least)
