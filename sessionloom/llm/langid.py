"""Language of texts by unigram piece models, summed over all segmentations of every word.

Pieces are the byte strings of a fixed public vocabulary; each language gives them probabilities,
learned by expectation-maximisation from labelled texts. The probability of a word is the sum over
all its segmentations into pieces, found by a forward pass over the bytes of many words at once.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.llm.arrays import blocks, distinct_words, held_for, word_spans
from sessionloom.llm.storage import batch_settings, store

LETTERS = re.compile(r"[^\W\d_]+")
LONGEST_PIECE = 8
LONGEST_WORD = 32  # bytes; longer runs of letters are cut into parts of this size
TRAIN_DOCS = 1000  # per language, those with the smallest hashes of doc_id
LANGUAGES = 200  # learned at most, those with the most labelled documents
ROUNDS = 4
FLOOR = 1e-3  # share of the probability that all pieces divide equally
SCALE = 16.0  # per byte, so that products of probabilities neither vanish nor overflow
EVIDENCE = 20  # words whose evidence a whole text has in its score
PRIOR_BYTES = 64  # of usual text that stand beside every text when its surprise is measured
KEEP = 400_000
UNKNOWN = "und"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> list[bytes]:
    """Byte strings of a byte-level vocabulary of at most LONGEST_PIECE bytes, without duplicates."""
    letters = byte_letters()
    with open(path, encoding="utf-8") as file:
        names = json.load(file)["model"]["vocab"]
    found = {bytes(letters[c] for c in n) for n in names if len(n) <= LONGEST_PIECE and all(c in letters for c in n)}
    found |= {bytes([b]) for b in range(256)}
    return sorted(found)


class Pieces:
    """Looks up byte strings of each length in the vocabulary."""

    def __init__(self, path: str) -> None:
        self.names = vocabulary(path)
        self.count = len(self.names)
        self.keys, self.numbers = [], []
        for size in range(1, LONGEST_PIECE + 1):
            packed = [(int.from_bytes(n, "big"), i) for i, n in enumerate(self.names) if len(n) == size]
            packed.sort()
            self.keys.append(np.array([k for k, _ in packed], np.uint64))
            self.numbers.append(np.array([i for _, i in packed], np.int64))

    def find(self, size: int, keys: np.ndarray) -> np.ndarray:
        """Numbers of the pieces of ``size`` bytes; ``count`` where there is none."""
        known = self.keys[size - 1]
        if not len(known):
            return np.full(len(keys), self.count)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, self.numbers[size - 1][at], self.count)

    def lattice(self, words: np.ndarray) -> list[list[np.ndarray]]:
        """For words of one length: at each end, the piece number for each length of the last piece."""
        rows, length = words.shape
        wide = words.astype(np.uint64)
        out = []
        for end in range(1, length + 1):
            key, found = np.zeros(rows, np.uint64), []
            for size in range(1, min(end, LONGEST_PIECE) + 1):
                key = key | (wide[:, end - size] << np.uint64(8 * (size - 1)))
                found.append(self.find(size, key))
            out.append(found)
        return out


_PIECES: dict[str, Pieces] = {}


def piece_table(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def scaled(probabilities: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Probabilities (pieces, languages) times SCALE per byte, with a last row of zeros."""
    sizes = np.array([len(n) for n in pieces.names])
    table = probabilities * (SCALE ** sizes)[:, None]
    return np.vstack([table, np.zeros(table.shape[1])])


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers, byte matrix) of the words of each length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    place = np.searchsorted(sizes[order], np.arange(sizes.max(initial=0) + 2))
    for size in range(1, len(place) - 1):
        some = order[place[size] : place[size + 1]]
        for low in range(0, len(some), 20_000):
            part = some[low : low + 20_000]
            joined = b"".join(words[i] for i in part)
            yield part, np.frombuffer(joined, np.uint8).reshape(len(part), size)


def log_marginals(words: list[bytes], table: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Log-probability of each word in each language, over all segmentations."""
    out = np.zeros((len(words), table.shape[1]))
    for numbers, matrix in by_length(words):
        alpha = [np.ones((len(numbers), table.shape[1]))]
        for found in pieces.lattice(matrix):
            total = np.zeros_like(alpha[0])
            for size, number in enumerate(found, 1):
                total += alpha[-size] * table[number]
            alpha.append(total)
        out[numbers] = np.log(alpha[-1]) - matrix.shape[1] * np.log(SCALE)
    return out


def expected_counts(words: list[bytes], weights: np.ndarray, table: np.ndarray, pieces: Pieces) -> np.ndarray:
    """How often each piece is used, over all segmentations of all words, in one language."""
    used = np.zeros(pieces.count + 1)
    for numbers, matrix in by_length(words):
        ways = pieces.lattice(matrix)
        length = len(ways)
        alpha = [np.ones(len(numbers))]
        for found in ways:
            alpha.append(sum(alpha[-size] * table[number] for size, number in enumerate(found, 1)))
        beta = [np.zeros(len(numbers)) for _ in range(length)] + [np.ones(len(numbers))]
        for end in range(length, 0, -1):
            for size, number in enumerate(ways[end - 1], 1):
                passed = table[number] * beta[end]
                beta[end - size] += passed
                share = alpha[end - size] * passed / alpha[-1] * weights[numbers]
                used += np.bincount(number, share, minlength=len(used))
    return used[:-1]


def letter_runs(word: bytes) -> list[bytes]:
    """The runs of letters of a word, in lower case after a space, in parts of bounded size."""
    runs = []
    for run in LETTERS.findall(word.decode("utf-8", "replace").lower()):
        raw = b" " + run.encode()
        runs.extend(raw[i : i + LONGEST_WORD] for i in range(0, len(raw), LONGEST_WORD))
    return runs


@dataclass
class Model:
    """Languages and, for each, the probabilities of the pieces of ``path`` and the log-probability
    that a byte of its training texts has in the mean."""

    path: str
    languages: list[str]
    probabilities: np.ndarray
    usual: np.ndarray


def in_training(docs: DataFrame) -> DataFrame:
    """Rows whose crc32 of doc_id leaves a remainder other than 2 on division by 4."""
    return docs.where((F.crc32(F.col("doc_id").cast("string")) % 4 != 2) & F.col("lang").isNotNull())


def training_ids(labelled: DataFrame, per_language: int, most_languages: int) -> DataFrame:
    """doc_id, lang of the rows with the ``per_language`` smallest hashes of doc_id in each of the
    ``most_languages`` languages with the most rows (ties: by code point).

    Rows are counted by ranges of the hash first, so that only those up to the range in which the last
    one lies are ranked, however many a language has.
    """
    hashed = labelled.select("doc_id", "lang", F.xxhash64("doc_id").alias("_hash")).withColumn(
        "_range", F.shiftright("_hash", 52)
    )
    counts = hashed.groupBy("lang", "_range").agg(F.count(F.lit(1)).alias("_n"))
    common = counts.groupBy("lang").agg(F.sum("_n").alias("_all")).orderBy(F.desc("_all"), "lang").limit(most_languages)
    before = F.sum("_n").over(W.partitionBy("lang").orderBy("_range")) - F.col("_n")
    last = (
        counts.withColumn("_before", before).where(F.col("_before") < per_language)
        .groupBy("lang").agg(F.max("_range").alias("_last")).join(common.select("lang"), "lang", "left_semi")
    )
    first = W.partitionBy("lang").orderBy("_hash", "doc_id")
    return (
        hashed.join(F.broadcast(last), "lang").where("_range <= _last")  # one row per language
        .withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") <= per_language).select("doc_id", "lang")
    )


def train(
    docs: DataFrame,
    path: str,
    text: str = "text",
    per_language: int = TRAIN_DOCS,
    rounds: int = ROUNDS,
    most_languages: int = LANGUAGES,
) -> Model:
    """Fit on whole texts of at most ``per_language`` documents of each language of ``docs``, of the
    ``most_languages`` with the most documents. Null texts and null languages teach nothing; rows of
    one doc_id and language are taken together."""
    spark = docs.sparkSession
    batch_settings(spark)
    labelled = docs.select("doc_id", "lang", F.col(text).alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    chosen = training_ids(labelled, per_language, most_languages)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_for("language")
        for batch in batches:
            names = batch.column("lang").to_pylist()
            totals: Counter = Counter()
            for low, _, data, edges in blocks(batch.column("text"), 1 << 16):
                starts, ends, first_word = word_spans(data, edges)
                for i in range(len(edges) - 1):
                    a, b = first_word[i], first_word[i + 1]
                    codes, words = distinct_words(data, starts[a:b], ends[a:b])
                    for word, n in zip(words, np.bincount(codes, minlength=len(words)).tolist()):
                        for run in letter_runs(word):
                            totals[names[low + i], run] += n
            keys = list(totals)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()),
                 pa.array(list(totals.values()), pa.int64())],
                ["lang", "word", "n"],
            )

    sample = labelled.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("lang", "text")
    words = store(
        sample.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")),
        "words",
    )
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    pieces = piece_table(path)
    chances = np.full((pieces.count, max(1, len(languages))), 1.0 / pieces.count)
    if not languages:
        return Model(path, [], chances, np.zeros(1))
    for _ in range(rounds):
        def expect(batches: Iterator[pa.RecordBatch], now=chances) -> Iterator[pa.RecordBatch]:
            known = piece_table(path)
            table = scaled(now, known)
            used = np.zeros((known.count, len(languages)))
            for batch in batches:
                names = np.array(batch.column("lang").to_pylist(), object)
                spelled = batch.column("word").to_pylist()
                counts = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
                for k, language in enumerate(languages):
                    mine = np.flatnonzero(names == language)
                    if len(mine):
                        used[:, k] += expected_counts([spelled[i] for i in mine], counts[mine], table[:, k], known)
            piece, k = np.nonzero(used)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece), pa.array(k), pa.array(used[piece, k])], ["piece", "k", "used"]
            )

        totals = (
            words.mapInArrow(expect, "piece long, k long, used double").groupBy("piece", "k")
            .agg(F.sum("used").alias("used")).toArrow()
        )  # at most pieces times languages
        used = np.zeros_like(chances)
        used[totals["piece"].to_numpy(), totals["k"].to_numpy()] = totals["used"].to_numpy()
        chances = (1 - FLOOR) * used / np.maximum(used.sum(axis=0), 1e-9) + FLOOR / pieces.count

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = piece_table(path)
        table = scaled(chances, known)
        for batch in batches:
            names = np.array(batch.column("lang").to_pylist(), object)
            spelled = batch.column("word").to_pylist()
            counts = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
            numbers, logs, sizes = [], [], []
            for k, language in enumerate(languages):
                mine = np.flatnonzero(names == language)
                words_here = [spelled[i] for i in mine]
                numbers.append(k)
                logs.append(float(counts[mine] @ log_marginals(words_here, table[:, [k]], known)[:, 0]))
                sizes.append(float(counts[mine] @ np.fromiter(map(len, words_here), float, len(mine))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int64()), pa.array(logs, pa.float64()), pa.array(sizes, pa.float64())],
                ["k", "logs", "bytes"],
            )

    sums = words.mapInArrow(measure, "k long, logs double, bytes double").groupBy("k").agg(
        F.sum("logs").alias("logs"), F.sum("bytes").alias("bytes")
    )
    usual = np.full(len(languages), -1.0)
    for row in sums.where("bytes > 0").collect():  # one row per language
        usual[row["k"]] = row["logs"] / row["bytes"]
    return Model(path, languages, chances, usual)


class Scorer:
    """Log-marginals of the words of texts; those of words seen before are kept by each worker."""

    def __init__(self, model: Model) -> None:
        self.pieces = piece_table(model.path)
        self.table = scaled(model.probabilities, self.pieces)
        self.empty()

    def empty(self) -> None:
        self.known: dict[bytes, int] = {}
        self.values = np.zeros((1 << 16, self.table.shape[1] + 2))
        self.used = 0

    def learn(self, words: list[bytes]) -> None:
        runs = [letter_runs(w) for w in words]
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        spelled = [r for some in runs for r in some]
        flat = np.column_stack([
            log_marginals(spelled, self.table, self.pieces), np.fromiter(map(len, spelled), float, len(spelled))
        ])
        total = np.concatenate([np.zeros((1, flat.shape[1])), np.cumsum(flat, axis=0)])
        ends = np.cumsum(sizes)
        while self.used + len(words) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        part = slice(self.used, self.used + len(words))
        self.values[part, :-1] = total[ends] - total[ends - sizes]
        self.values[part, -1] = sizes
        self.known.update(zip(words, range(self.used, self.used + len(words))))
        self.used += len(words)

    def score(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """For each text the sums of its words' log-marginals, and of the bytes and the number of its
        letter runs."""
        starts, ends, first = word_spans(data, edges)
        codes, words = distinct_words(data, starts, ends)
        if len(self.known) + len(words) > KEEP:
            self.empty()
        get = self.known.get
        self.learn([w for w in words if get(w) is None])
        slots = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[codes]
        sums = np.empty((len(edges) - 1, self.values.shape[1]))
        for k in range(sums.shape[1]):
            total = np.concatenate([[0.0], np.cumsum(self.values[slots, k])])
            sums[:, k] = total[first[1:]] - total[first[:-1]]
        return sums


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred, score and surprise to the rows of ``docs``; columns of these names are replaced.

    The score is the posterior of the best language among those learned, from the mean evidence of
    a word times its number of words, at most EVIDENCE. The surprise is the text's log-probability per
    byte in that language, with PRIOR_BYTES of usual text beside it, over the one of the training
    texts: about 1 for texts like those, the higher the less a text is in any language learned. Ties
    go to the first language by code point; equal texts get equal results. A text that is null or has
    no letter has the language ``und``, score and surprise 0; so has every text if none was learned.
    """
    batch_settings(docs.sparkSession)
    left = docs.drop("lang_pred", "score", "surprise")
    names = left.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_for("language")
        scorer = Scorer(model) if model.languages else None
        for batch in batches:
            texts, best, sure, odd = batch.column(names.index(text)), [], [], []
            for low, high, data, edges in blocks(texts):
                if scorer is None:
                    best += [UNKNOWN] * (high - low)
                    sure.append(np.zeros(high - low))
                    odd.append(np.zeros(high - low))
                    continue
                sums = scorer.score(data, edges)
                runs, size = sums[:, -1], sums[:, -2]
                logs = sums[:, :-2] * (np.minimum(runs, EVIDENCE) / np.maximum(runs, 1))[:, None]
                odds = np.exp(logs - logs.max(axis=1, keepdims=True))
                odds /= odds.sum(axis=1, keepdims=True)
                top = odds.argmax(axis=1)
                best += [model.languages[k] if r else UNKNOWN for k, r in zip(top.tolist(), runs.tolist())]
                sure.append(np.where(runs > 0, odds.max(axis=1), 0.0))
                usual, whole = model.usual[top], sums[np.arange(len(top)), top]
                share = (whole / usual + PRIOR_BYTES) / (size + PRIOR_BYTES)
                odd.append(np.where(runs > 0, share, 0.0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(best, pa.string()), *(pa.array(np.concatenate([np.zeros(0), *x])) for x in (sure, odd))],
                [*names, "lang_pred", "score", "surprise"],
            )

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema.fields]
    return left.mapInArrow(judge, ", ".join([*kinds, "lang_pred string", "score double", "surprise double"]))


def kept_documents(docs: DataFrame, model: Model, least_score: float, most_surprise: float, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with their own columns, whose language is one of the model's with at least
    ``least_score`` and at most ``most_surprise``. Texts that are null or have no letter go; a short text
    stays unless its letters are very unlikely. Repeated rows are judged alike and stay repeated."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(0).alias("none")]
    judged = predict(docs.select(F.struct(*others).alias("_row"), F.col(text).alias("text")), model)
    kept = judged.where(
        (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score) & (F.col("surprise") <= most_surprise)
    )
    return kept.select(*[F.col("text" if c == text else f"_row.`{c}`").alias(c) for c in docs.columns])


def identify(docs: DataFrame, path: str, text: str = "text", per_language: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, repeated ones too; rows held out are not learned
    from. A row without doc_id is not held out and not learned from."""
    model = train(in_training(docs), path, text, per_language)
    rest = F.crc32(F.col("doc_id").cast("string")) % 4
    plain = docs.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    return predict(plain, model).select("doc_id", "held_out", "lang_pred", "score")
