"""Packing documents into token sequences along a space-filling curve."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.llm.arrays import blocks, held_for, mixed, quick_word_hashes, span_list, word_spans
from sessionloom.llm.storage import batch_settings, parts_for, store
from sessionloom.llm.tokens import encoder, with_end

DIMS = 4
BITS = 10
REACH = 4.0  # coordinates beyond this many standard deviations share the outer cells
PART_BYTES = 24 << 20
WEIGHT_BYTES = 1 << 10  # text bytes that count as one more key where ranges are balanced


def doc_points(data: np.ndarray, edges: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Texts as points: every word adds one random sign per axis, drawn from its hash."""
    starts, ends, first = word_spans(data, edges)
    bits = mixed(quick_word_hashes(data, starts, ends), 11)
    sums = np.empty((len(edges) - 1, dims))
    for axis in range(dims):
        signs = ((bits >> np.uint64(axis)) & np.uint64(1)).astype(np.int64) * 2 - 1
        total = np.concatenate([[0], np.cumsum(signs)])
        sums[:, axis] = np.diff(total[first])
    return sums / np.sqrt(np.maximum(np.diff(first), 1))[:, None]


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of points with integer coordinates below 2 ** bits.

    The axes are turned and mirrored level by level from the coarsest (Gray code of the cell), and
    the bits of all axes are then read off in turn.
    """
    axes = [cells[:, i].astype(np.int64).copy() for i in range(cells.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(len(axes)):
            high = (axes[i] & q) != 0
            swap = np.where(high, 0, (axes[0] ^ axes[i]) & low)
            axes[0] ^= np.where(high, low, swap)
            if i:
                axes[i] ^= swap
        q >>= 1
    for i in range(1, len(axes)):
        axes[i] ^= axes[i - 1]
    turn = np.zeros_like(axes[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((axes[-1] & q) != 0, q - 1, 0)
        q >>= 1
    key = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ turn) >> bit) & 1)
    return key


def curve_keys(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    cells = (doc_points(data, edges) + REACH) / (2 * REACH) * (1 << BITS)
    return hilbert(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64))


def curve_order(docs: DataFrame, text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, text, curve and part, split into ranges of the curve and sorted by (curve, doc_id, text).

    The curve is cut at quantiles, weighted by text size, of the keys of every 16th document by hash,
    which only balance the ranges; every document gets its own key. Documents with one key are dealt by a hash of doc_id
    over the ranges that end in it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"]
    parts = parts_for(size, part_bytes)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                np.repeat(curve_keys(data, edges), 1 + np.diff(edges) // WEIGHT_BYTES)
                for _, _, data, edges in blocks(batch.column("text"))
            ]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["curve"])

    bounds = np.zeros(0, np.int64)
    if parts > 1:
        some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(16)) == 0).select("text").mapInArrow(keys, "curve long")
        shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        found = some.agg(F.percentile_approx("curve", shares, max(10_000, 10 * parts)).alias("p")).first()["p"]
        bounds = np.array(found or [], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_for("packing")
        for batch in batches:
            found = [curve_keys(data, edges) for _, _, data, edges in blocks(batch.column("text"))]
            curve = np.concatenate([np.zeros(0, np.int64), *found])
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(bounds, curve, "left"), np.searchsorted(bounds, curve, "right")
            part = low + (mixed(ids.astype(np.uint64), 12) % (high - low + 1).astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array(curve), pa.array(part.astype(np.int32))],
                ["doc_id", "text", "curve", "part"],
            )

    placed = rows.mapInArrow(place, "doc_id long, text string, curve long, part int")
    return placed.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("curve", "doc_id", "text")


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    length: int = 4096,
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens; neighbours on the curve share sequences.

    Every range of the curve is one stream of ids, each document followed by ``end_id``, cut every
    ``length`` ids; only the last sequence of a range is shorter. Sequence numbers of a range follow
    those of the ranges before it, by prefix sums over the ranges. One row per piece: doc_id, start
    (ids of the document before it), length, ids_crc32, doc_tokens, sequence_id, offset, and the ids
    where asked for. A null text is empty and packs its end id alone; repeated rows are packed each.
    """
    batch_settings(docs.sparkSession)
    ordered = curve_order(docs, text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, filled = encoder(tokenizer), 0
        for batch in batches:
            keys = batch.column("doc_id")
            for low, high, data, edges in blocks(batch.column("text")):
                ids, first = with_end(*coder.encode(data, edges), end_id)
                lows, highs = first[:-1] + filled, first[1:] + filled
                count = (highs - 1) // length - lows // length + 1
                row = np.repeat(np.arange(high - low), count)
                sequence = span_list(lows // length, count)
                begin = np.maximum(lows[row], sequence * length)
                end = np.minimum(highs[row], (sequence + 1) * length)
                raw = np.ascontiguousarray(ids, "<u4")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin - filled, end - filled)]
                columns = {
                    "part": batch.column("part").slice(low, high - low).take(pa.array(row)),
                    "doc_id": keys.slice(low, high - low).take(pa.array(row)),
                    "start": pa.array(begin - lows[row]),
                    "length": pa.array(end - begin),
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "doc_tokens": pa.array((highs - lows)[row]),
                    "sequence": pa.array(sequence),
                    "offset": pa.array(begin % length),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(
                        pa.array(np.append(begin - filled, len(ids)).astype(np.int32)),
                        pa.array(ids.astype(np.int64)),
                    )
                filled += len(ids)
                yield pa.RecordBatch.from_pydict(columns)

    schema = (
        "part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence long, offset long" + ", ids array<long>" * with_ids
    )
    placed = store(ordered.mapInArrow(cut, schema), "pieces")
    sizes = placed.groupBy("part").agg((F.max("sequence") + 1).alias("_n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return placed.join(F.broadcast(base), "part").select(
        *names, (F.col("_base") + F.col("sequence")).alias("sequence_id"), "offset",
        *(["ids"] if with_ids else []),
    )
