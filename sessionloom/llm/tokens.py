"""Token ids of whole texts: a public tokenizer runs once for each distinct word with its gap.

Texts are cut before the last white space of a run that precedes a word. Tokenizers that split at
white space before they merge give the same ids for the parts as for the whole text, so ids of parts
are kept and put together. Cuts stand only before bytes that cannot begin a wide white space.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from sessionloom.llm.arrays import held_for, pieces, quick_word_hashes, solid, span_list

KEEP = 800_000  # distinct parts held by a worker; beyond, the half seen most stays, ids do not change

# Bytes before which a cut is safe: not white space, not the controls 0x1C-0x1F, and not the first
# byte of a wide white space (U+0085, U+00A0, U+1680, U+2000-U+205F, U+3000).
AFTER_CUT = np.ones(256, bool)
AFTER_CUT[[*range(9, 14), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = False
AFTER_CUT[0x80:0xC0] = False
JOINS = re.compile(rb"[\x09-\x0D\x20][^\x09-\x0D\x1C-\x20\x80-\xC2\xE1-\xE3]")  # the beginning of a part after a cut


def part_cuts(
    data: np.ndarray, edges: np.ndarray, special: tuple[bytes, ...] = ()
) -> tuple[np.ndarray, np.ndarray]:
    """(cuts, first): byte offsets of all parts (one more than parts), and the number of the first
    part of each text (one more than texts).

    A tokenizer takes its ``special`` strings out first, so white space before one ends a piece of
    text and is not cut from what stands before it.
    """
    marks = np.zeros(len(data) + 1, bool)
    marks[edges] = True
    if len(data):
        gap = np.flatnonzero(~solid(data))
        gap = gap[~marks[gap + 1]]  # at the end of a text nothing follows
        marks[gap[AFTER_CUT[data[gap + 1]]]] = True
        body = data.tobytes() if special else b""
        for name in special:
            at = body.find(name)
            while at >= 0:
                marks[max(at - 1, 0)] = False
                at = body.find(name, at + len(name))
        marks[edges] = True
    cuts = np.flatnonzero(marks)
    return cuts, np.searchsorted(cuts, edges)


def room(values: np.ndarray, size: int) -> np.ndarray:
    """The values with space for ``size`` rows or more; space that is not used takes no memory."""
    if size <= len(values):
        return values
    out = np.zeros((max(size, 2 * len(values)), *values.shape[1:]), values.dtype)
    out[: len(values)] = values
    return out


class TextEncoder:
    """Encodes blocks of texts; ``spans`` also keeps the character span of every token."""

    def __init__(self, path: str, spans: bool = False, keep: int = KEEP) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = tuple(sorted(token.content.encode() for token in added))
        self.spans, self.keep = spans, keep
        self.empty()

    def empty(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # of the known parts, sorted, and their numbers
        self.numbers = np.zeros(0, np.int32)
        self.count = self.used = self.spelled = 0
        self.text = np.zeros(1 << 18, np.uint8)  # the known parts one after the other
        self.ends = np.zeros(1 << 16, np.int64)
        self.at = np.zeros(1 << 16, np.int64)  # of each known part: its first id, the number of ids
        self.many = np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.where = np.zeros((1 << 18 if self.spans else 0, 2), np.int32)
        self.seen = np.zeros(1 << 16, np.int64)

    def spellings(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where known parts begin in the store, and their lengths."""
        begins = np.where(numbers > 0, self.ends[numbers - 1], 0)
        return begins, self.ends[numbers] - begins

    def shrink(self) -> None:
        """Keep the half of the store that was seen most."""
        count = self.count
        best = np.sort(np.argsort(-self.seen[:count], kind="stable")[: self.keep // 2])
        left = np.full(count, -1, np.int32)
        left[best] = np.arange(len(best), dtype=np.int32)
        moved = left[self.numbers]
        self.hashes, self.numbers = self.hashes[moved >= 0], moved[moved >= 0]
        begins, sizes = self.spellings(best)
        size = self.many[best]
        place = span_list(self.at[best], size.astype(np.int64))
        text = self.text[span_list(begins, sizes)]
        self.count, self.used, self.spelled = len(best), len(place), len(text)
        self.text[: self.spelled] = text
        self.ends[: self.count] = np.cumsum(sizes)
        self.seen[: self.count] = self.seen[best]
        self.at[: self.count] = np.cumsum(size) - size
        self.many[: self.count] = size
        self.ids[: self.used] = self.ids[place]
        if self.spans:
            self.where[: self.used] = self.where[place]

    def find(self, hashes: np.ndarray, text: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Numbers of the parts with these hashes and bytes; -1 where one is not known."""
        if not self.count:
            return np.full(len(hashes), -1, np.int64)
        order = np.argsort(hashes)
        near = np.empty(len(hashes), np.int64)
        near[order] = np.searchsorted(self.hashes, hashes[order])
        near = np.minimum(near, len(self.hashes) - 1)
        number = self.numbers[near].astype(np.int64)
        begins, sizes = self.spellings(number)
        alike = np.flatnonzero((self.hashes[near] == hashes) & (sizes == np.diff(edges)))
        found = np.full(len(hashes), -1, np.int64)
        same = self.text[span_list(begins[alike], sizes[alike])] == text[span_list(edges[:-1][alike], sizes[alike])]
        wrong = np.concatenate([[0], np.cumsum(~same)])
        ends = np.cumsum(sizes[alike])
        equal = wrong[ends] == wrong[ends - sizes[alike]]
        found[alike[equal]] = number[alike[equal]]
        return found

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list]:
        """(ids, number of ids of each word, character spans).

        Without spans, words that begin as after a cut go in as one text, as they could stand in one, and
        tell their ids by where these begin. The others go in as one text with an added token between
        them, which the tokenizer takes out first, and its id marks their ends; a word that holds it is
        encoded like the others one by one.
        """
        texts = [w.decode("utf-8", "replace") for w in words]
        if self.spans:
            found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
            ids, size = self.one_by_one(found)
            return ids, size, [s for e in found for s in e.offsets]
        joins = np.fromiter((JOINS.match(w) is not None for w in words), bool, len(words))
        row, rest = np.flatnonzero(joins), np.flatnonzero(~joins)
        joined = self.joined_ids([texts[i] for i in row])
        if joined is None or not len(rest):
            return *(joined or self.marked_ids(texts)), []
        apart = self.marked_ids([texts[i] for i in rest])
        size = np.empty(len(words), np.int64)
        size[row], size[rest] = joined[1], apart[1]
        first = np.cumsum(size) - size
        ids = np.empty(size.sum(), np.uint32)
        for some, (own, many) in ((row, joined), (rest, apart)):
            ids[span_list(first[some], many)] = own
        return ids, size, []

    def one_by_one(self, found: list) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array([i for e in found for i in e.ids], np.uint32)
        return ids, np.array([len(e) for e in found], np.int64)

    def joined_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, number of ids of each text) of texts set side by side; None where that is not clear."""
        whole = "".join(texts)
        if any(name.decode() in whole for name in self.special):
            return None
        found = self.tokenizer.encode_batch([whole], add_special_tokens=False)[0]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        owner = np.searchsorted(ends, np.array([begin for begin, _ in found.offsets], np.int64), "right")
        if len(owner) and (np.diff(owner).min(initial=0) < 0 or owner[-1] >= len(texts)):
            return None
        return np.array(found.ids, np.uint32), np.bincount(owner, minlength=len(texts))

    def marked_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of texts with an added token between them, or one by one."""
        if self.special:
            mark = self.special[0].decode()
            found = self.tokenizer.encode_batch_fast([mark.join(texts)], add_special_tokens=False)[0].ids
            ids = np.array(found, np.uint32)
            ends = np.flatnonzero(ids == self.tokenizer.token_to_id(mark))
            if len(ends) == len(texts) - 1:
                return np.delete(ids, ends), np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1
        return self.one_by_one(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def learn(self, words: list[bytes], hashes: np.ndarray) -> None:
        """Add parts to the store; of several with one hash the first one is found by it."""
        begun = self.count
        for low in range(0, len(words), 2000):
            some = words[low : low + 2000]
            flat, size, spans = self.ids_of(some)
            text, count = np.frombuffer(b"".join(some), np.uint8), self.count
            new, used, spelled = count + len(some), self.used + len(flat), self.spelled + len(text)
            self.at, self.many, self.seen, self.ends = (room(x, new) for x in (self.at, self.many, self.seen, self.ends))
            self.ids, self.text = room(self.ids, used), room(self.text, spelled)
            self.at[count:new] = self.used + np.cumsum(size) - size
            self.many[count:new] = size
            self.seen[count:new] = 0
            self.ends[count:new] = self.spelled + np.cumsum(np.fromiter(map(len, some), np.int64, len(some)))
            self.ids[self.used : used] = flat
            self.text[self.spelled : spelled] = text
            if self.spans:
                self.where = room(self.where, used)
                self.where[self.used : used] = np.array(spans, np.int32).reshape(-1, 2)
            self.count, self.used, self.spelled = new, used, spelled
        new = np.concatenate([self.hashes, hashes])
        numbers = np.concatenate([self.numbers, np.arange(begun, self.count, dtype=np.int32)])
        order = np.argsort(new, kind="stable")
        self.hashes, self.numbers = new[order], numbers[order]
        first = np.diff(self.hashes, prepend=~self.hashes[:1]) != 0
        if not first.all():
            self.hashes, self.numbers = self.hashes[first], self.numbers[first]

    def encode(self, data: np.ndarray, edges: np.ndarray):
        """(ids, first) of a block; with ``spans`` also (starts, ends), characters in each text."""
        cuts, parts = part_cuts(data, edges, self.special)
        if len(cuts) < 2:
            none = np.zeros(0, np.int64)
            found = (np.zeros(0, np.uint32), np.zeros(len(edges), np.int64))
            return (*found, none, none) if self.spans else found
        coded = pieces(data, cuts).dictionary_encode()
        codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        _, place, body = words.buffers()
        ends = np.frombuffer(place, np.int64)[words.offset : words.offset + len(words) + 1]
        text = np.frombuffer(body, np.uint8)
        hashes = quick_word_hashes(text, ends[:-1], ends[1:], fold=False)
        known = self.find(hashes, text, ends)
        new = np.flatnonzero(known < 0)
        if len(new) and self.count + len(new) > self.keep and self.count > self.keep // 2:
            self.shrink()
            known = self.find(hashes, text, ends)
            new = np.flatnonzero(known < 0)
        if len(new):
            known[new] = self.count + np.arange(len(new))
            self.learn(words.take(pa.array(new)).to_pylist(), hashes[new])
        self.seen[known] += np.bincount(codes, minlength=len(words))
        slots = known[codes]
        sizes = self.many[slots].astype(np.int64)
        place = span_list(self.at[slots], sizes)
        total = np.concatenate([[0], np.cumsum(sizes)])
        first = total[parts]
        ids = self.ids[place]
        if not self.spans:
            return ids, first
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        heads = chars[cuts[:-1]] - np.repeat(chars[edges[:-1]], np.diff(parts))
        shift = np.repeat(heads, sizes)
        return ids, first, self.where[place, 0] + shift, self.where[place, 1] + shift


def encoder(path: str, spans: bool = False, keep: int = KEEP) -> TextEncoder:
    """The encoder of this worker process, kept until another operator works in it."""
    kept = held_for("tokens")
    if (path, spans, keep) not in kept:
        kept[path, spans, keep] = TextEncoder(path, spans, keep)
    return kept[path, spans, keep]


def with_end(ids: np.ndarray, first: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of every text followed by ``end_id``."""
    texts = len(first) - 1
    out = np.empty(len(ids) + texts, ids.dtype)
    after = first + np.arange(texts + 1)
    stop = np.zeros(len(out), bool)
    stop[after[1:] - 1] = True
    out[stop] = end_id
    out[~stop] = ids
    return out, after


def long_column(values: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(values, np.int64))
