"""Whole texts of an Arrow batch as byte blocks, word spans and word hashes.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Spans are found with vector operations on
the bytes of many texts at once; work that needs Python is done once for each distinct word.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
SLICE_BYTES = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


_HELD: dict[str, dict] = {}
_POWERS: dict[str, np.ndarray] = {}
LIBC = ctypes.CDLL(None)  # of glibc, whose malloc keeps what is freed


def held_for(operator: str) -> dict:
    """What this worker process keeps from task to task for one operator; what it kept for another one
    is let go, since workers outlive stages and their stores would add up. What it has freed by then goes
    back to the system."""
    others = [n for n in _HELD if n != operator]
    for name in others:
        del _HELD[name]
    if others:
        _POWERS.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(LIBC, "malloc_trim"):
            LIBC.malloc_trim(0)
    return _HELD.setdefault(operator, {})


def blocks(
    texts: pa.Array, most: int = BLOCK_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, edges) for runs of whole texts of about ``most`` bytes.

    Edges are the byte offsets of the texts in the block, one more than texts. A null text is an
    empty one; a text longer than ``most`` is a block of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    _, place, body = texts.buffers()
    edges = np.frombuffer(place, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    low, rows = 0, len(texts)
    while low < rows:
        high = max(low + 1, int(np.searchsorted(edges, edges[low] + most, "right")) - 1)
        yield low, high, data[edges[low] : edges[high]], edges[low : high + 1] - edges[low]
        low = high


def solid(data: np.ndarray) -> np.ndarray:
    """True for the bytes of words."""
    return (data != 32) & ((data - np.uint8(9)) > 4)


def word_spans(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words, and the number of the first word of each text
    (one more than texts). No word crosses an edge."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(edges), np.int64)
    inside = solid(data)
    opens = np.empty(len(data) + 1, bool)
    opens[0] = True
    opens[1:] = ~inside
    opens[edges] = True
    starts = np.flatnonzero(opens[:-1] & inside)
    shut = np.empty(len(data) + 1, bool)
    shut[:-1] = ~inside
    shut[edges] = True
    ends = np.flatnonzero(shut[1:] & inside) + 1
    return starts, ends, np.searchsorted(starts, edges)


def pieces(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Byte strings between consecutive cuts, without a copy."""
    place = np.ascontiguousarray(cuts, np.int64)
    return pa.Array.from_buffers(
        pa.large_binary(),
        len(place) - 1,
        [None, pa.py_buffer(place), pa.py_buffer(np.ascontiguousarray(data))],
    )


def distinct_words(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, list[bytes]]:
    """(codes, words): the code of each word and the byte strings the codes stand for.

    Strings run to the start of the next word, so they end in white space and one word can have
    several codes; callers strip them.
    """
    if not len(starts):
        return np.zeros(0, np.int32), []
    coded = pieces(data, np.append(starts, ends[-1])).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of all words with A-Z in lower case."""
    codes, words = distinct_words(data, starts, ends)
    digest = xxhash.xxh3_64_intdigest
    values = np.fromiter((digest(w.strip().lower()) for w in words), np.uint64, len(words))
    return values[codes]


def mixed(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that leaves no pattern of the input."""
    x = values + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def odd_numbers(count: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, count + 1, dtype=np.uint64), seed) | np.uint64(1)


BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64


def powers(name: str, base: int, size: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2 ** 64, at least ``size`` of them."""
    known = _POWERS.get(name, np.ones(1, np.uint64))
    while len(known) < size:
        known = np.concatenate([known, known * np.uint64(pow(base, len(known), 1 << 64))])
    if len(known) <= 4 * SLICE_BYTES:
        _POWERS[name] = known
    return known


def quick_word_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = SLICE_BYTES, fold: bool = True
) -> np.ndarray:
    """64-bit hashes of all words, with ``fold`` A-Z in lower case, as polynomials of their bytes from prefix
    sums over runs of about ``most`` bytes. For projections; to tell texts apart, use word_hashes."""
    letters = odd_numbers(256, 31)
    if fold:
        letters[65:91] = letters[97:123]
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        base = int(starts[low])
        high = max(low + 1, int(np.searchsorted(ends, base + most, "right")))
        size = int(ends[high - 1]) - base
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(letters[data[base : base + size]] * powers("up", BASE, size)[:size], out=total[1:])
        begin = starts[low:high] - base
        down = powers("down", pow(BASE, -1, 1 << 64), size)
        out[low:high] = (total[ends[low:high] - base] - total[begin]) * down[begin]
        low = high
    return out


def within(first: np.ndarray) -> np.ndarray:
    """For groups that start at ``first`` (one more than groups): the place of each item in its group."""
    sizes = np.diff(first)
    return np.arange(first[-1] - first[0]) - np.repeat(first[:-1] - first[0], sizes)


def span_list(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every span, one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    full = sizes > 0
    starts, sizes = starts[full], sizes[full]
    heads = np.cumsum(sizes) - sizes
    out[0] = starts[0]
    out[heads[1:]] = starts[1:] - starts[:-1] - sizes[:-1] + 1
    return np.cumsum(out)


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Values as an Arrow list column whose rows start at ``first`` (one more than rows)."""
    return pa.ListArray.from_arrays(
        pa.array(np.asarray(first, np.int32)), pa.array(values, type=kind)
    )


def word_array(text: Column) -> Column:
    """The words of a text as a native array column; empty for null."""
    parts = F.split(F.coalesce(text, F.lit("")), GAP)
    return F.filter(parts, lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words of a text as a native column; 0 for null."""
    parts = F.split(F.coalesce(text, F.lit("")), GAP)
    ends = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when(
        F.size(parts) > 1, F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    ).otherwise(0)
    return (F.size(parts) - ends).cast("long")
