"""Workers of the text operators: what they hold, and what it costs."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sessionloom.llm import arrays, queries, tokens

NAMES = [queries.BYTE_TOKENIZER, queries.WORD_TOKENIZER]


def drawn(count, seed=5):
    draw = random.Random(seed)
    letters = "aeioubdkt\u00e9\u0301\u1e9e\u0130"
    return ["w" + "".join(draw.choice(letters) for _ in range(draw.randrange(5, 12))) + str(i) for i in range(count)]


def test_a_known_part_takes_few_bytes():
    """A worker holds a million of them; as Python objects each one of these took 115 bytes."""
    coder = tokens.TextEncoder(queries.BYTE_TOKENIZER, keep=100_000)
    data = " ".join(f"w{i}" for i in range(60_000)).encode()
    tracemalloc.start()
    coder.encode(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    arrays._POWERS.clear()
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 60 * 60_000


@pytest.mark.parametrize("name", NAMES)
def test_new_parts_are_encoded_side_by_side(name, monkeypatch):
    """New parts cost the tokenizer no added token between them, and keep their own ids."""
    plain, words = Tokenizer.from_file(name), drawn(3000)
    parts = [f" {w}" for w in words] + ["Ab", "a\u0301", " <|endoftext|>", "\n\u0301x", "  ", "\u3000", " 's", "\t<"]
    random.Random(1).shuffle(parts)
    coder, marked = tokens.TextEncoder(name), []
    apart = coder.marked_ids
    monkeypatch.setattr(coder, "marked_ids", lambda texts: marked.extend(texts) or apart(texts))
    ids, size, _ = coder.ids_of([p.encode() for p in parts])
    ends = np.cumsum(size)
    for part, low, high in zip(parts, ends - size, ends):
        assert ids[low:high].tolist() == plain.encode(part, add_special_tokens=False).ids, part
    assert len(marked) < 20 or any("<|endoftext|>" in m for m in marked)
    marked.clear()
    coder.ids_of([f" {w}".encode() for w in words])
    assert not marked


@pytest.mark.parametrize("spans", [False, True])
def test_parts_with_one_hash_are_told_apart(spans, monkeypatch):
    monkeypatch.setattr(tokens, "quick_word_hashes", lambda text, begins, ends, fold: (ends - begins).astype(np.uint64) % 3)
    name, texts = queries.WORD_TOKENIZER, [" ".join(drawn(9, s)) for s in range(40)] * 2
    plain, coder = Tokenizer.from_file(name), tokens.TextEncoder(name, spans, keep=100)
    for low in range(0, len(texts), 8):
        for first, end, data, edges in arrays.blocks(pa.array(texts[low : low + 8])):
            ids, begin = coder.encode(data, edges)[:2]
            for i in range(end - first):
                want = plain.encode(texts[low + first + i], add_special_tokens=False).ids
                assert ids[begin[i] : begin[i + 1]].tolist() == want


def test_freed_memory_goes_back_when_another_operator_begins(monkeypatch):
    class Libc:
        trimmed = 0

        def malloc_trim(self, pad):
            self.trimmed += 1

    libc = Libc()
    monkeypatch.setattr(arrays, "LIBC", libc)
    arrays.held_for("tokens")
    before = libc.trimmed
    arrays.powers("up", arrays.BASE, 1000)
    arrays.held_for("tokens")
    assert libc.trimmed == before and arrays._POWERS
    arrays.held_for("language")
    assert libc.trimmed == before + 1 and not arrays._POWERS
