"""License notices in texts, found by patience alignment with templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.arrays import blocks, distinct_words, span_list, word_spans
from sessionloom.llm.storage import batch_settings


class License(NamedTuple):
    """A text to look for. Each phrase of ``telling`` must be aligned without a gap; a span that holds a
    phrase of ``never`` is another license."""

    text: str
    telling: tuple[str, ...] = ()
    never: tuple[str, ...] = ()


# Public license texts and notices.
NO_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
    "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES "
    "OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met: 1. Redistributions of source code must retain the "
    "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in "
    "binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution. "
)
BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
    "or promote products derived from this software without specific prior written permission. "
)
BSD_NO_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
    "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
    "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
GNU_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the "
    "{name} as published by the Free Software Foundation, either version {version} of the License, or (at "
    "your option) any later version. This program is distributed in the hope that it will be useful, but "
    "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
    "PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} "
    "along with this program. If not, see <https://www.gnu.org/licenses/>."
)
GNU = {
    "GPL-2.0": ("GNU General Public License", "2"),
    "GPL-3.0": ("GNU General Public License", "3"),
    "LGPL-2.1": ("GNU Lesser General Public License", "2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License", "3"),
    "AGPL-3.0": ("GNU Affero General Public License", "3"),
}
NAMED = {
    "MIT": "MIT License",
    "BSD": "BSD License",
    "ISC": "ISC License",
    "Apache-1.1": "Apache License, Version 1.1",
    "Apache-2.0": "Apache License, Version 2.0",
    "MPL-2.0": "Mozilla Public License, Version 2.0",
}
CREATIVE_COMMONS = ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")
TEXTS = {
    "MIT": License(
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software. "
        + NO_WARRANTY,
        ("permission is hereby granted, free of charge",),
        ("advertising or otherwise to promote",),
    ),
    "BSD-2-Clause": License(
        BSD_CONDITIONS + BSD_NO_WARRANTY, ("redistribution and use",), ("endorse or promote products",)
    ),
    "BSD-3-Clause": License(
        BSD_CONDITIONS + BSD_NAMES + BSD_NO_WARRANTY,
        ("redistribution and use", "endorse or promote products"),
        ("all advertising materials mentioning",),
    ),
    "ISC": License(
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
        "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
        "in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH "
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO "
        "EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
        "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
        ("with or without fee", "provided that the above copyright notice"),
    ),
    "Zlib": License(
        "This software is provided 'as-is', without any express or implied warranty. In no event will the "
        "authors be held liable for any damages arising from the use of this software. Permission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this "
        "software must not be misrepresented; you must not claim that you wrote the original software. If "
        "you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and "
        "must not be misrepresented as being the original software. 3. This notice may not be removed or "
        "altered from any source distribution.",
        ("altered source versions must be plainly marked",),
    ),
    "Unlicense": License(
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
        "modify, publish, use, compile, sell, or distribute this software, either in source code form or "
        "as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ("released into the public domain",),
    ),
    "Apache-2.0": License(
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
        "in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License.",
        ("apache license, version 2.0",),
    ),
    "MPL-2.0": License(
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
        "the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        ("mozilla public license, v. 2.0",),
    ),
}
TEMPLATES = (
    TEXTS
    | {k: License(GNU_NOTICE.format(name=n, version=v), (f"terms of the {n}", f"version {v}")) for k, (n, v) in GNU.items()}
    | {f"{k}-notice": License(f"This work is licensed under the {n}, version {v}.", (n, f"version {v}")) for k, (n, v) in GNU.items()}
    | {f"{k}-notice": License(f"Released under the {n}.", (n,)) for k, n in NAMED.items()}
    | {f"CC-{k}-4.0-notice": License(f"Licensed under CC {k} 4.0.", (f"CC {k} 4.0",)) for k in CREATIVE_COMMONS}
)

LEAST_COVERAGE = 0.75
EDGES = re.compile(rb"^[^0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff]+$")


def bare(word: bytes) -> bytes:
    """A word in lower case without punctuation at its ends."""
    return EDGES.sub(b"", word.lower())


def longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first number, whose second numbers rise: piles of
    patience sorting, each card with a link to the top of the pile before."""
    tops: list[int] = []
    cards: list[int] = []
    link = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        if pile:
            link[i] = cards[pile - 1]
        if pile == len(tops):
            tops.append(b)
            cards.append(i)
        else:
            tops[pile], cards[pile] = b, i
    out, i = [], cards[-1] if cards else -1
    while i >= 0:
        out.append(pairs[i])
        i = link[i]
    return out[::-1]


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """Matching places of two word lists: words unique to both are anchors, the longest rising run of
    them holds, and the gaps between are aligned in the same way. Equal words at the ends of a range
    match first; a range without anchors ends there."""
    found, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_b = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        pairs = [(i, at_b[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in at_b]
        anchors = longest_rising(pairs)
        if not anchors:
            continue
        found.extend(anchors)
        marks = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        open_.extend((i + 1, k, j + 1, m) for (i, j), (k, m) in zip(marks, marks[1:]))
    return sorted(found)


def apart(found: list[tuple[str, float, int, int, int]]) -> list[tuple[str, float, int, int]]:
    """Of (name, coverage, first word, last word, matched words) those that do not overlap, more matched
    words first; ties by coverage, place and name."""
    firsts: list[int] = []
    lasts: list[int] = []
    out = []
    for name, coverage, first, last, _ in sorted(found, key=lambda f: (-f[4], -f[1], f[2], f[0])):
        at = bisect_left(firsts, first)
        if (at and lasts[at - 1] >= first) or (at < len(firsts) and firsts[at] <= last):
            continue
        firsts.insert(at, first)
        lasts.insert(at, last)
        out.append((name, coverage, first, last))
    return sorted(out, key=lambda f: (-f[1], f[0], f[2]))


class Templates:
    """Templates as word numbers, and the phrases that tell them from each other."""

    def __init__(self, texts: dict[str, License | str]) -> None:
        self.names = sorted(texts)
        whole = [t if isinstance(t, License) else License(t) for t in (texts[n] for n in self.names)]
        words = [self.split(t.text) for t in whole]
        spoken = [w for t in whole for phrase in t.never for w in self.split(phrase)]
        self.known = {w: i for i, w in enumerate(sorted({w for some in words for w in some} | set(spoken)))}
        self.words = [np.array([self.known[w] for w in some], np.int64) for some in words]
        self.telling = [[self.phrase(p) for p in t.telling] for t in whole]
        self.never = [[self.phrase(p) for p in t.never] for t in whole]
        self.uses = np.zeros((len(self.known), len(words)), np.int64)
        for t, some in enumerate(self.words):
            np.add.at(self.uses[:, t], some, 1)
        self.sizes = np.array([len(w) for w in self.words])
        self.order = [np.argsort(some, kind="stable") for some in self.words]

    @staticmethod
    def split(text: str) -> list[bytes]:
        return [w for w in map(bare, text.encode().split()) if w]

    def phrase(self, text: str) -> list[int]:
        """Word numbers; a word of no template has -2, which no word of a text has."""
        return [self.known.get(w, -2) for w in self.split(text)]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words; -1 for those in no template."""
        get = self.known.get
        return np.fromiter((get(bare(w.strip()), -1) for w in words), np.int64, len(words))

    def meetings(self, numbers: np.ndarray, here: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in the text, place in the template) of all equal words."""
        sorted_words = self.words[t][self.order[t]]
        low = np.searchsorted(sorted_words, numbers[here], "left")
        many = np.searchsorted(sorted_words, numbers[here], "right") - low
        return np.repeat(here, many), self.order[t][span_list(low, many)]

    def tells(self, t: int, numbers: np.ndarray, pairs: list[tuple[int, int]], low: int) -> bool:
        """Every telling phrase is aligned without a gap, and no other license is named in the span."""
        at = {j: i for i, j in pairs}
        mine = self.words[t].tolist()
        for phrase in self.telling[t]:
            starts = (j for j in range(len(mine) - len(phrase) + 1) if mine[j : j + len(phrase)] == phrase)
            if not any(j in at and all(at.get(j + k) == at[j] + k for k in range(len(phrase))) for j in starts):
                return False
        span = numbers[low + pairs[0][0] : low + pairs[-1][0] + 1].tolist()
        return not any(span[i : i + len(p)] == p for p in self.never[t] for i in range(len(span) - len(p) + 1))

    def scan(self, numbers: np.ndarray, least: float) -> list[tuple[str, float, int, int]]:
        """(name, coverage, first word, last word) of all places, none over another, where a template is
        covered to ``least`` or more.

        A place lies in a band of diagonals (place in the text less place in the template) one template
        wide; bands start at every half template, so words may be added or missing up to half of one.
        Only words that meet the template inside the band are aligned, so a copy next to it does not
        count against words being unique, and a band with too few of them is not aligned at all.
        """
        present = np.zeros(len(self.known), bool)
        present[numbers[numbers >= 0]] = True
        found = []
        for t in np.flatnonzero(present.astype(np.int64) @ self.uses >= least * self.sizes):
            size, half = int(self.sizes[t]), max(1, int(self.sizes[t]) // 2)
            wanted = np.append(self.uses[:, t] > 0, False)  # the last for words in no template
            p, q = self.meetings(numbers, np.flatnonzero(wanted[numbers]), t)
            band = (p - q) // half
            cells = np.unique(np.concatenate([band, band - 1]) * size + np.concatenate([q, q]))
            bands, many = np.unique(cells // size, return_counts=True)
            order = np.argsort(band, kind="stable")
            sorted_band = band[order]
            for b in bands[many >= least * size].tolist():
                inside = p[order[np.searchsorted(sorted_band, b) : np.searchsorted(sorted_band, b + 2)]]
                low, high = int(inside.min()), int(inside.max()) + 1
                part = np.full(high - low, -1)
                part[inside - low] = numbers[inside]
                pairs = aligned(part.tolist(), self.words[t].tolist())
                if len(pairs) >= least * size and self.tells(t, numbers, pairs, low):
                    found.append((self.names[t], len(pairs) / size, low + pairs[0][0], low + pairs[-1][0], len(pairs)))
        return apart(found)


def license_scan(
    docs: DataFrame,
    templates: dict[str, License | str] | None = None,
    text: str = "text",
    least: float = LEAST_COVERAGE,
) -> DataFrame:
    """doc_id, n_licenses, license, coverage (of the best covered place; of equals the first by name),
    and ``found``: every place, none over another, where a template is covered to ``least`` or more and
    its telling phrases are, with the numbers of the first and last matching word. A text without any,
    empty or null has 0, null, 0.0 and an empty list. Repeated rows are scanned each; other columns
    are left out."""
    batch_settings(docs.sparkSession)
    texts = dict(TEMPLATES if templates is None else templates)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    entry = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(texts)
        for batch in batches:
            for low, high, data, edges in blocks(batch.column("text")):
                starts, ends, first = word_spans(data, edges)
                codes, words = distinct_words(data, starts, ends)
                numbers = known.numbers(words)[codes] if len(words) else codes.astype(np.int64)
                found = [known.scan(numbers[a:b], least) for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, high - low),
                        pa.array([len(f) for f in found], pa.int64()),
                        pa.array([f[0][0] if f else None for f in found], pa.string()),
                        pa.array([f[0][1] if f else 0.0 for f in found], pa.float64()),
                        pa.array(
                            [[dict(zip(("license", "coverage", "first_word", "last_word"), x)) for x in f] for f in found],
                            pa.list_(entry),
                        ),
                    ],
                    ["doc_id", "n_licenses", "license", "coverage", "found"],
                )

    return rows.mapInArrow(
        scan,
        "doc_id long, n_licenses long, license string, coverage double, "
        "found array<struct<license: string, coverage: double, first_word: long, last_word: long>>",
    )
