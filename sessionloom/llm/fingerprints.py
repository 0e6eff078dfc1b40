"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: at line breaks, and within lines after words picked by their bytes,
so that an edit changes only the paragraphs it touches. A paragraph's digest (with its occurrence in
the text) is added to one cell of each of three tables. The cells of two versions are subtracted;
cells that hold one digest are peeled off, which frees others, until all digests that differ are
found. Where peeling gets stuck, both texts are sketched again with twice the cells.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.arrays import blocks, mixed, within, word_spans
from sessionloom.llm.storage import batch_settings, parts_for

TABLES = 3
CELLS = 8  # of each table of a stored fingerprint
PART_BYTES = 24 << 20
TURNS = 64


@dataclass
class Digests:
    """Paragraph digests of texts one after the other; ``first`` has one entry more than texts."""

    values: np.ndarray
    first: np.ndarray

    def of(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text numbers, digests) of some texts, which are numbered anew."""
        sizes = np.diff(self.first)[texts]
        at = np.repeat(self.first[texts] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.repeat(np.arange(len(texts)), sizes), self.values[at]


def paragraph_digests(texts: list[str]) -> Digests:
    """Digests of the paragraphs of every text; equal paragraphs differ by their occurrence."""
    values, first = [], [0]
    for _, _, data, edges in blocks(pa.array(texts, pa.large_string())):
        starts, ends, _ = word_spans(data, edges)
        pick = (data[ends - 1].astype(np.int64) * 31 + data[starts] * 7 + (ends - starts) * 13) % 8 == 0
        marks = np.zeros(len(data) + 1, bool)
        marks[ends[pick]] = True
        marks[np.flatnonzero(data == 10) + 1] = True
        marks[edges] = True
        cuts = np.flatnonzero(marks)
        view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
        places = cuts.tolist()
        raw = np.fromiter((digest(view[a:b]) for a, b in zip(places, places[1:])), np.uint64, max(0, len(cuts) - 1))
        bounds = np.searchsorted(cuts, edges)
        if len(cuts) < 2:
            bounds = np.zeros(len(edges), np.int64)
        owner = np.repeat(np.arange(len(edges) - 1), np.diff(bounds)).astype(np.uint64)
        tied = raw ^ mixed(owner, 9)  # one key for text and digest
        order = np.argsort(tied, kind="stable")
        fresh = np.ones(len(raw), bool)
        fresh[1:] = tied[order][1:] != tied[order][:-1]
        heads = np.append(np.flatnonzero(fresh), len(raw))
        occurrence = np.empty(len(raw), np.uint64)
        occurrence[order] = within(heads).astype(np.uint64)
        values.append(mixed(raw + occurrence * np.uint64(0x9E3779B97F4A7C15), 3))
        first.extend((bounds[1:] + first[-1]).tolist())
    return Digests(np.concatenate([np.zeros(0, np.uint64), *values]), np.array(first, np.int64))


def cells_of(owner: np.ndarray, digests: np.ndarray, cells: int) -> np.ndarray:
    """(TABLES, digests): the cell of each digest in each table of its text."""
    places = [
        (owner * TABLES + t) * cells + (mixed(digests, 20 + t) % np.uint64(cells)).astype(np.int64)
        for t in range(TABLES)
    ]
    return np.stack(places)


def sketch(owner: np.ndarray, digests: np.ndarray, texts: int, cells: int) -> tuple[np.ndarray, ...]:
    """Counts, digest sums and check sums of the cells of all texts."""
    size = texts * TABLES * cells
    count, total, check = np.zeros(size, np.int64), np.zeros(size, np.uint64), np.zeros(size, np.uint64)
    proof = mixed(digests, 30)
    for places in cells_of(owner, digests, cells):
        np.add.at(count, places, 1)
        np.add.at(total, places, digests)
        np.add.at(check, places, proof)
    return count, total, check


def peel(count: np.ndarray, total: np.ndarray, check: np.ndarray, texts: int, cells: int):
    """(found, solved) of subtracted sketches: per recovered digest (text, digest, sign), and for
    each text whether nothing is left."""
    found = []
    for _ in range(TURNS * cells):
        one = np.flatnonzero(np.abs(count) == 1)
        sign = count[one]
        value = np.where(sign > 0, total[one], ~total[one] + np.uint64(1))
        proof = mixed(value, 30)
        good = np.where(sign > 0, check[one], ~check[one] + np.uint64(1)) == proof
        one, sign, value = one[good], sign[good], value[good]
        if not len(one):
            break
        owner = one // (TABLES * cells)
        _, pick = np.unique(np.stack([owner.astype(np.uint64), value]), axis=1, return_index=True)
        owner, value, sign = owner[pick], value[pick], sign[pick]
        found.append((owner, value, sign))
        less = np.where(sign > 0, value, ~value + np.uint64(1))
        proof = mixed(value, 30)
        proof = np.where(sign > 0, proof, ~proof + np.uint64(1))
        for places in cells_of(owner, value, cells):
            np.subtract.at(count, places, sign)
            np.subtract.at(total, places, less)
            np.subtract.at(check, places, proof)
    left = (count != 0) | (total != 0) | (check != 0)
    solved = ~left.reshape(texts, -1).any(axis=1) if texts else np.zeros(0, bool)
    if not found:
        none = np.zeros(0, np.int64)
        return (none, none.astype(np.uint64), none), solved
    return tuple(np.concatenate(x) for x in zip(*found)), solved


def differing(a: Digests, b: Digests, cells: int = CELLS) -> np.ndarray:
    """For each pair of texts the number of paragraph digests in only one of them."""
    texts = len(a.first) - 1
    out, open_ = np.zeros(texts, np.int64), np.arange(texts)
    gap = np.abs(np.diff(a.first) - np.diff(b.first))
    while len(open_):
        now = open_[gap[open_] <= TABLES * cells]  # more differ than there are cells in the others
        if len(now):
            x, y = sketch(*a.of(now), len(now), cells), sketch(*b.of(now), len(now), cells)
            (owner, _, _), solved = peel(*(p - q for p, q in zip(x, y)), len(now), cells)
            counts = np.bincount(owner, minlength=len(now))
            out[now[solved]] = counts[solved]
            open_ = np.setdiff1d(open_, now[solved], assume_unique=True)
        cells *= 2
    return out


def likeness(a: Digests, b: Digests) -> np.ndarray:
    """Digests in both texts by those in either, from the differences; 1 for two empty texts."""
    both = np.diff(a.first) + np.diff(b.first)
    apart = differing(a, b)
    return np.where(both > 0, (both - apart) / np.maximum(both + apart, 1), 1.0)


def fingerprint_texts(digests: Digests) -> list[str]:
    """Number of digests and the cells of the stored size, in base 64."""
    texts = len(digests.first) - 1
    count, total, check = sketch(*digests.of(np.arange(texts)), texts, CELLS)
    width = TABLES * CELLS
    raw = np.concatenate(
        [
            count.astype("<u4").reshape(texts, width).view(np.uint8),
            total.astype("<u8").reshape(texts, width).view(np.uint8),
            check.astype("<u4").reshape(texts, width).view(np.uint8),
        ],
        axis=1,
    ) if texts else np.zeros((0, width * 16), np.uint8)
    sizes = np.diff(digests.first).tolist()
    return [f"{n}:{base64.b64encode(row.tobytes()).decode()}" for n, row in zip(sizes, raw)]


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the next text's, or all it has."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def compared(keys: pa.Array, texts: list[str]) -> pa.RecordBatch:
    """Rows of all texts but the last, each compared with its edited text and the next one."""
    own, edits = texts[:-1], [edited(a, b) for a, b in zip(texts, texts[1:])]
    every = paragraph_digests(texts)
    last = every.first[-2]
    mine = Digests(every.values[:last], every.first[:-1])
    following = Digests(every.values[every.first[1] :], every.first[1:] - every.first[1])
    changed = paragraph_digests(edits)
    return pa.RecordBatch.from_arrays(
        [
            keys,
            pa.array([len(t) for t in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edits], pa.string()),
            pa.array(fingerprint_texts(mine), pa.string()),
            pa.array(fingerprint_texts(changed), pa.string()),
            pa.array(likeness(mine, changed), pa.float64()),
            pa.array(likeness(mine, following), pa.float64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def fingerprints(docs: DataFrame, text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likenesses.

    Documents are split by doc_id (null first) at values that occur; the first document of a part is
    also sent to the part before, and the first of all to the last, so every task has the next
    document of all of its own. Rows of one doc_id stand in the order of their texts; a null text is
    an empty one.
    """
    batch_settings(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    facts = rows.agg(
        F.sum(F.octet_length("text")).alias("bytes"), F.min("doc_id").alias("least"),
        F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls"),
    ).first()
    parts, least = parts_for(facts["bytes"], part_bytes), facts["least"]
    limits: list[int] = []
    if parts > 1 and least is not None:
        shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        found = rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 100 * parts)).alias("p")).first()["p"]
        limits = sorted(set(found) - ({least} if not facts["nulls"] else set()))
    bounds = np.array(limits, np.int64)
    last = len(limits)
    opening = F.col("doc_id").isNull() if facts["nulls"] else F.col("doc_id") == F.lit(least)

    @F.pandas_udf("array<int>")
    def homes(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        values = ids.fillna(0).to_numpy(np.int64)
        part = np.where(known, np.searchsorted(bounds, values, "right"), 0)
        head = known & (part > 0) & (bounds[np.maximum(part - 1, 0)] == values) if len(bounds) else np.zeros(len(ids), bool)
        return pd.Series([[p, p - 1] if h else [p] for p, h in zip(part.tolist(), head.tolist())], dtype=object)

    placed = rows.withColumn("_homes", homes("doc_id"))
    wrap = F.when(opening, F.array(F.lit(last + 1))).otherwise(F.array().cast("array<int>"))
    spread = placed.select("doc_id", "text", F.posexplode(F.concat("_homes", wrap)).alias("_guest", "_part")).select(
        "doc_id", "text", (F.col("_guest") > 0).alias("guest"), F.least("_part", F.lit(last)).alias("part")
    )
    ordered = spread.repartitionById(last + 1, "part").sortWithinPartitions("guest", "doc_id", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_text = None, None
        done = False
        for batch in batches:
            if done or not len(batch):
                continue
            guests = batch.column("guest").to_numpy(zero_copy_only=False)
            end = int(np.argmax(guests)) + 1 if guests.any() else len(guests)
            done = bool(guests.any())
            for low in range(0, end, 500):
                part = batch.slice(low, min(500, end - low))
                texts, keys = part.column("text").to_pylist(), part.column("doc_id")
                if held_text is not None:
                    texts, keys = [held_text, *texts], pa.concat_arrays([held_key, keys])
                if len(texts) > 1:
                    yield compared(keys.slice(0, len(texts) - 1), texts)
                held_key, held_text = keys.slice(len(texts) - 1, 1), texts[-1]

    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return ordered.mapInArrow(compare, schema)
