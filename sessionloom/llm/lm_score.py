"""Masked pseudo-likelihood of texts by a bidirectional window network.

A token is a word's hash bucket. Every bucket has an input vector; the vectors of two words to the
left and two to the right, weighed by side, add up to a hidden vector, which gives the probability of
the class of the word between and, by a second softmax over the members of that class, of its bucket.
Classes are runs of buckets in falling order of their counts, cut so that the square roots of the
counts add up to about the same in each, few frequent buckets or many rare ones. The network starts
as a unigram model. The sum of the logarithms over all words scores a text.

Counts come from all documents, and the window around every word is trained on in every round. Each
part trains on its texts; afterwards every row of weights is averaged over the parts, by how often a
part used it. The number of parts grows with the square root of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.arrays import blocks, pieces, word_hashes, word_spans
from sessionloom.llm.storage import batch_settings, store

BUCKETS = 1 << 16
CLASSES = 256
SIDES = (-2, -1, 1, 2)
HIDDEN = 16
ROUNDS = 1
BATCH = 1 << 14
RATE = 0.1
SLICE = 1 << 14
PART_SCALE = 1 << 17  # windows over which one part would be enough
RUN = 1 << 10  # windows whose probabilities are held at once, small enough for the processor's cache
SUM_ROWS = 1 << 12  # rows of weights that are added up together


@dataclass
class Network:
    """All weights as rows of one table: input vectors by rank of the bucket (the last one stands
    beyond the text), member vectors by rank, class vectors, side weights. The last column holds the
    bias of members and classes."""

    table: np.ndarray  # float32
    rank_of: np.ndarray  # of each bucket, by falling count
    edges: np.ndarray  # first rank of each class, and the number of buckets

    def __post_init__(self) -> None:
        v, c = len(self.rank_of), len(self.edges) - 1
        self.class_of = np.repeat(np.arange(c, dtype=np.int32), np.diff(self.edges))  # of each rank
        self.starts = np.cumsum([0, v + 1, v, c, len(SIDES)])  # of the four kinds of rows

    def kinds(self, table: np.ndarray) -> list[np.ndarray]:
        """Views of the rows of input, member, class and side weights."""
        return [table[a:b] for a, b in zip(self.starts, self.starts[1:])]

    def copy(self, table: np.ndarray | None = None) -> Network:
        return Network((self.table if table is None else table).copy(), self.rank_of, self.edges)

    def hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vectors beside every word, and the hidden vectors."""
        inputs, _, _, sides = self.kinds(self.table)
        seen = inputs[:, :-1][context]
        return seen, np.tanh(np.einsum("bkh,kh->bh", seen, sides[:, :-1]))

    def by_class(self, classes: np.ndarray) -> Iterator[tuple[slice, slice]]:
        """For sorted classes: the windows of each class with several members, and its members."""
        found, first = np.unique(classes, return_index=True)
        for c, low, high in zip(found, first, [*first[1:], len(classes)]):
            if self.edges[c + 1] - self.edges[c] > 1:
                yield slice(low, high), slice(self.edges[c], self.edges[c + 1])

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of the target ranks."""
        _, members, tops, _ = self.kinds(self.table)
        out = np.empty(len(target))
        for low in range(0, len(target), SLICE):
            want = target[low : low + SLICE]
            order = np.argsort(self.class_of[want], kind="stable")
            want = want[order]
            classes = self.class_of[want]
            _, h = self.hidden(context[low : low + SLICE][order])
            logs = _log_share(h, tops, classes)
            for rows, own in self.by_class(classes):
                logs[rows] += _log_share(h[rows], members[own], want[rows] - own.start)
            out[low + order] = logs
        return out

    def gradient(self, context: np.ndarray, target: np.ndarray) -> list[tuple[slice | np.ndarray, np.ndarray]]:
        """(rows, gradient) of the negated log-probability, summed over the windows. Windows come in
        the order of their classes."""
        inputs, members, tops, sides = self.kinds(self.table)
        first_input, first_member, first_top, first_side = self.starts[:4]
        classes = self.class_of[target]
        seen, h = self.hidden(context)
        found = []
        back, step = _backward(h, tops, classes)
        found.append((slice(first_top, first_side), step))
        for rows, own in self.by_class(classes):
            more, step = _backward(h[rows], members[own], target[rows] - own.start)
            back[rows] += more
            found.append((slice(first_member + own.start, first_member + own.stop), step))
        back *= 1 - h * h
        step = np.zeros_like(sides)
        step[:, :-1] = np.einsum("bkh,bh->kh", seen, back)
        found.append((slice(first_side, None), step))
        flat = context.ravel()
        order = np.argsort(flat, kind="stable")
        sorted_ids = flat[order]
        begins = np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))
        each = (back[:, None, :] * sides[:, :-1]).reshape(len(flat), -1)[order]
        step = np.zeros((len(begins), inputs.shape[1]), np.float32)
        step[:, :-1] = np.add.reduceat(each, begins, axis=0)
        found.append((first_input + sorted_ids[begins], step))
        return found

    def train(self, context: np.ndarray, target: np.ndarray, squares: np.ndarray, rate: float) -> None:
        """One pass over the windows; a row's step shrinks with the root of its summed squares."""
        for low in range(0, len(target), BATCH):
            want = target[low : low + BATCH]
            order = np.argsort(self.class_of[want], kind="stable")
            for rows, step in self.gradient(context[low : low + BATCH][order], want[order]):
                squares[rows] += np.einsum("rh,rh->r", step, step) / step.shape[1]
                self.table[rows] -= rate * step / np.sqrt(squares[rows])[:, None]


def _exponentials(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(logits) and the logits' shift: their maximum where they could overflow, else none."""
    logits = h @ rows[:, :-1].T
    logits += rows[:, -1]
    shift = np.zeros((len(logits), 1), logits.dtype)
    if np.abs(rows).sum(axis=1).max() > 60:  # hidden values lie between -1 and 1
        shift = logits.max(axis=1, keepdims=True)
        logits -= shift
    return np.exp(logits, out=logits), shift


def _log_share(h: np.ndarray, rows: np.ndarray, want: np.ndarray) -> np.ndarray:
    out = np.empty(len(h))
    for low in range(0, len(h), RUN):
        some, own = h[low : low + RUN], rows[want[low : low + RUN]]
        p, shift = _exponentials(some, rows)
        hit = np.einsum("bh,bh->b", some, own[:, :-1]) + own[:, -1] - shift[:, 0]
        out[low : low + RUN] = hit - np.log(p.sum(axis=1))
    return out


def _backward(h: np.ndarray, rows: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the negated log-share by the hidden vectors and by the rows."""
    back, step = np.empty_like(h), np.zeros_like(rows)
    for low in range(0, len(h), RUN):
        some, own = h[low : low + RUN], want[low : low + RUN]
        p, _ = _exponentials(some, rows)
        whole = p.sum(axis=1)
        p[np.arange(len(own)), own] -= whole
        by_whole = 1 / whole[:, None]
        step += p.T @ np.concatenate([some * by_whole, by_whole], axis=1)
        back[low : low + RUN] = (p @ rows[:, :-1]) * by_whole
    return back, step


def contexts(ranks: np.ndarray, first: np.ndarray, outside: int) -> np.ndarray:
    """The ranks beside every word; ``outside`` stands for places beyond its text."""
    out = np.full((len(ranks), len(SIDES)), outside, np.int32)
    text_of = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    for k, side in enumerate(SIDES):
        n = max(len(ranks) - abs(side), 0)
        here, there = (slice(len(ranks) - n, None), slice(0, n)) if side < 0 else (slice(0, n), slice(len(ranks) - n, None))
        out[here, k] = np.where(text_of[here] == text_of[there], ranks[there], outside)
    return out


def word_buckets(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(data, edges)
    return (word_hashes(data, starts, ends) % np.uint64(BUCKETS)).astype(np.int64), first


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id and the buckets of all words of every text, 16 bits each."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, edges in blocks(batch.column("text")):
                buckets, first = word_buckets(data, edges)
                ids = pieces(buckets.astype("<u2").view(np.uint8), 2 * first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), ids.cast(pa.binary())], ["doc_id", "ids"]
                )

    return docs.mapInArrow(encode, "doc_id long, ids binary")


def decoded(ids: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, buckets, first) for runs of encoded texts: their buckets, and the number of
    the first word of each text (one more than texts)."""
    for low, high, data, edges in blocks(ids):
        yield low, high, data.view("<u2"), edges // 2


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Occurrences of each bucket in all encoded texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, buckets, _ in decoded(batch.column("ids")):
                total += np.bincount(buckets, minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    sums = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)  # one number for each bucket at most
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def fresh_network(counts: np.ndarray, seed: int, classes: int = CLASSES) -> Network:
    """A unigram model: counts by half more than seen as biases, no weight on the hidden vector."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    rank_of = np.empty(len(counts), np.int32)
    rank_of[order] = np.arange(len(counts), dtype=np.int32)
    share = counts[order] + 0.5
    roots = np.cumsum(np.sqrt(share))
    number = np.floor((roots - np.sqrt(share) / 2) / roots[-1] * classes).astype(np.int64)
    edges = np.concatenate([np.flatnonzero(np.diff(number, prepend=-1)), [len(counts)]])
    c = len(edges) - 1
    table = np.zeros((2 * len(counts) + 1 + c + len(SIDES), HIDDEN + 1), np.float32)
    network = Network(table, rank_of, edges)
    inputs, members, tops, sides = network.kinds(table)
    inputs[:, :-1] = np.random.default_rng(seed).normal(0, 0.3, (len(counts) + 1, HIDDEN))
    of_class = np.add.reduceat(share, edges[:-1])
    members[:, -1] = np.log(share / of_class[network.class_of])
    tops[:, -1] = np.log(of_class / of_class.sum())
    sides[:, :-1] = 1
    return network


def trained(texts: DataFrame, rounds: int = ROUNDS, seed: int = 3, rate: float = RATE) -> Network:
    """Counts over all encoded texts, then rounds of training in every part and averaging."""
    counts = bucket_counts(texts)
    network = fresh_network(counts, seed)
    parts = max(1, int(np.ceil(np.sqrt(counts.sum() / PART_SCALE))))
    parted = texts.select("ids").where(F.length("ids") > 0).repartition(parts)
    width = HIDDEN + 2

    for turn in range(rounds):
        def step(batches: Iterator[pa.RecordBatch], now=network, speed=rate / (1 + turn)) -> Iterator[pa.RecordBatch]:
            own, used = now.copy(), np.zeros(len(now.table))
            squares = np.full(len(now.table), 0.1, np.float32)
            inputs, members, tops, sides = now.kinds(used)
            outside = len(now.rank_of)
            for _, _, buckets, first in (run for batch in batches for run in decoded(batch.column("ids"))):
                ranks = now.rank_of[buckets]
                context = contexts(ranks, first, outside)
                own.train(context, ranks, squares, speed)
                inputs += np.bincount(context.ravel(), minlength=outside + 1)
                members += np.bincount(now.class_of[ranks], minlength=len(now.edges) - 1)[now.class_of]
                tops += len(ranks)
                sides += len(ranks)
            if sides[0]:
                rows = np.column_stack([own.table, used]).astype("<f4")
                for low in range(0, len(rows), SUM_ROWS):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([low // SUM_ROWS], pa.int32()), pa.array([rows[low : low + SUM_ROWS].tobytes()])],
                        ["block", "rows"],
                    )

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}  # at most one table of weights
            for batch in batches:
                for block, raw in zip(batch.column("block").to_pylist(), batch.column("rows").to_pylist()):
                    rows = np.frombuffer(raw, "<f4").reshape(-1, width).astype(np.float64)
                    rows[:, :-1] *= rows[:, -1:]
                    sums[block] = sums[block] + rows if block in sums else rows
            for block, rows in sums.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int32()), pa.array([rows.tobytes()])], ["block", "rows"]
                )

        table = network.table.copy()
        kind = "block int, rows binary"
        sums = parted.mapInArrow(step, kind).repartition("block").mapInArrow(add, kind).toArrow()  # one table
        for block, raw in zip(sums["block"].to_pylist(), sums["rows"].to_pylist()):
            rows = np.frombuffer(raw, np.float64).reshape(-1, width)
            low, seen = block * SUM_ROWS, rows[:, -1] > 0
            table[low : low + len(rows)][seen] = (rows[seen, :-1] / rows[seen, -1:]).astype(np.float32)
        network = network.copy(table)
    return network


def scores(texts: DataFrame, network: Network) -> DataFrame:
    """Scores of encoded texts."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, buckets, first in decoded(batch.column("ids")):
                ranks = network.rank_of[buckets]
                logs = network.log_probabilities(contexts(ranks, first, len(network.rank_of)), ranks)
                total = np.concatenate([[0.0], np.cumsum(logs)])
                sums, sizes = total[first[1:]] - total[first[:-1]], np.diff(first)
                mean = sums / np.maximum(sizes, 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, high - low), pa.array(sizes), pa.array(sums),
                        pa.array(mean, mask=sizes == 0), pa.array(np.exp(-mean), mask=sizes == 0),
                    ],
                    ["doc_id", "n_tokens", "log_prob", "mean_log_prob", "perplexity"],
                )

    return texts.mapInArrow(
        judge, "doc_id long, n_tokens long, log_prob double, mean_log_prob double, perplexity double"
    )


def encoded_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``encoded`` rows of a table, written once. Workers started from here on compute in one thread:
    small products on more threads cost several times the processor time."""
    batch_settings(docs.sparkSession)
    docs.sparkSession.sparkContext.environment.update(OPENBLAS_NUM_THREADS="1", OMP_NUM_THREADS="1", MKL_NUM_THREADS="1")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return store(encoded(rows), "texts")


def pseudo_likelihood(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_tokens, log_prob, mean_log_prob, perplexity of every row of ``docs``.

    The network is trained on the same documents. A text that is null or has no word has n_tokens 0,
    log_prob 0 and a null mean and perplexity; repeated rows are scored, and trained on, as often as
    they come; an empty table gives no rows. Other columns are not read.
    """
    texts = encoded_texts(docs, text)
    return scores(texts, trained(texts, rounds))
