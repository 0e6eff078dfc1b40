"""Token counts of sections from one encoding of the whole document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.arrays import blocks, lists
from sessionloom.llm.storage import batch_settings
from sessionloom.llm.tokens import encoder

RULES = ("start", "longest")


def line_sections(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(heads, first): characters at which the lines of each text begin, with the line break at a
    line's end, and the number of the first line of each text. An empty text is one empty line."""
    breaks = np.flatnonzero(data == 10) + 1
    owner = np.searchsorted(edges, breaks, "left") - 1
    breaks = breaks[breaks < edges[owner + 1]] if len(breaks) else breaks
    marks = np.sort(np.concatenate([edges[:-1], breaks]), kind="stable")
    sizes = np.bincount(
        np.searchsorted(edges, breaks, "right") - 1, minlength=len(edges) - 1
    ) if len(breaks) else np.zeros(len(edges) - 1, np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return chars[marks] - np.repeat(chars[edges[:-1]], sizes + 1), first


def attribute(
    starts: np.ndarray, ends: np.ndarray, tokens: np.ndarray, heads: np.ndarray, sections: np.ndarray, rule: str
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join token spans to the sections that cover them: (tokens of every section, tokens of every
    text that touch two sections or more, section of every token).

    Positions get a prefix for their text, so one sorted search serves a block. ``start`` gives a
    token to the section of its first character, ``longest`` to the one with most of its characters
    (the earlier of equals). Every token counts once.
    """
    texts = len(tokens) - 1
    wide = int(max(ends.max(initial=0), heads.max(initial=0))) + 2
    text_of = np.repeat(np.arange(texts), np.diff(tokens))
    places = heads + np.repeat(np.arange(texts), np.diff(sections)) * wide
    begin = np.searchsorted(places, starts + text_of * wide, "right") - 1
    last = np.searchsorted(places, np.maximum(ends - 1, starts) + text_of * wide, "right") - 1
    chosen = begin.copy()
    if rule == "longest":
        for i in np.flatnonzero(last > begin):
            low, high, span = starts[i], ends[i], range(begin[i], last[i] + 1)
            limits = [*heads[begin[i] + 1 : last[i] + 1], high]
            share = [min(limits[k], high) - max(heads[s], low) for k, s in enumerate(span)]
            chosen[i] = begin[i] + int(np.argmax(share))
    counts = np.bincount(chosen, minlength=len(heads))
    return counts, np.bincount(text_of, last > begin, minlength=texts).astype(np.int64), chosen


def section_token_counts(
    docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", rule: str = "start"
) -> DataFrame:
    """Per document: n_tokens, n_sections, section_tokens (tokens of each line), n_crossing (tokens
    that touch two lines or more; ``rule`` says which line counts them).

    A document is encoded once as a whole; the sum of section_tokens is n_tokens. A null text is
    empty: no tokens and one empty section. Repeated rows give repeated rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    batch_settings(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, spans=True)
        for batch in batches:
            for low, high, data, edges in blocks(batch.column("text"), 2 << 20):
                _, tokens, starts, ends = coder.encode(data, edges)
                heads, sections = line_sections(data, edges)
                counts, crossing, _ = attribute(starts, ends, tokens, heads, sections, rule)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").slice(low, high - low),
                        pa.array(np.diff(tokens)),
                        pa.array(np.diff(sections)),
                        lists(counts, sections, pa.int64()),
                        pa.array(crossing),
                    ],
                    ["key", "n_tokens", "n_sections", "section_tokens", "n_crossing"],
                )

    schema = f"key {kind}, n_tokens long, n_sections long, section_tokens array<long>, n_crossing long"
    return rows.mapInArrow(count, schema).withColumnRenamed("key", key)
