"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargofile.llm.common import alphanumeric_table, runs

TABLE = alphanumeric_table()
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
LEAST_COVERAGE = 0.8
# Words of a fingerprint at most, and edits that lose no place however short a template is.
GRAM, EDITS = 3, 2
SHARD_WORDS = 200_000
# A cell of an alignment in one integer: score, matches, and how far its first word lies before the last possible one.
FIRST_BITS, MATCH_BITS = 22, 18
MATCH, SCORE = 1 << FIRST_BITS, 1 << (FIRST_BITS + MATCH_BITS)
# Words of text that a candidate spans at most; longer ones are cut and overlap.
PIECE = 65_536

# License notices, and whole texts (without their copyright line).
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.""",
}


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split()


def shifted(row: np.ndarray, at: int, lo: int, hi: int) -> np.ndarray:
    """Cells lo to hi of a row that begins at `at`; zero outside."""
    out = np.zeros(hi - lo, np.int64)
    first, last = max(lo, at), min(hi, at + len(row))
    if first < last:
        out[first - lo:last - lo] = row[first - at:last - at]
    return out


def cells(text: np.ndarray, template: np.ndarray, start: int, band: int):
    """(first word, cells) of the local alignment of each template word, for the words of text within band of a diagonal.

    Scores 1 for a match, -1 for a substitution or a gap; 0 where nothing of positive score ends. Of equal scores the
    alignment with more matches wins, then the one that starts first.
    """
    before, at = np.zeros(0, np.int64), 0
    for i, word in enumerate(template.tolist()):
        lo = min(max(0, start + i - band), len(text))
        hi = max(lo, min(len(text), start + i + band + 1))
        place = np.arange(lo, hi, dtype=np.int64)
        corner = shifted(before, at, lo - 1, hi - 1)
        hit = np.where(corner > 0, corner + (SCORE + MATCH), SCORE + MATCH + MATCH - 1 - place)
        now = np.where(text[lo:hi] == word, hit, corner - SCORE)
        now = np.maximum(now, shifted(before, at, lo, hi) - SCORE)
        # Gaps in the template: the best of all cells before, less one for every word between.
        steps = (place - lo) * SCORE
        now = np.maximum.accumulate(now + steps) - steps
        now[now < SCORE] = 0
        yield lo, now
        before, at = now, lo


def aligned(text: list[bytes], template: list[bytes], start: int, band: int) -> tuple[int, int, int]:
    """(matched template words, first and last word of text) of the best local alignment within band of a diagonal.

    Of equal scores the one with more matches wins, then the first to end.
    """
    ids = {w: k for k, w in enumerate(dict.fromkeys(template), 1)}
    best, out = 0, (0, 0, -1)
    for lo, row in cells(np.array([ids.get(w, 0) for w in text]), np.array([ids[w] for w in template]), start, band):
        top = int(np.argmax(row // MATCH)) if len(row) else 0
        if len(row) and row[top] // MATCH > best:
            best = int(row[top]) // MATCH
            out = best % (1 << MATCH_BITS), MATCH - 1 - int(row[top]) % MATCH, lo + top
    return out


def winnowed(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the grams that are smallest (the last of equals) in some window of so many grams in a row."""
    if len(grams) < window:
        return np.arange(len(grams))
    every = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(np.arange(len(every)) + window - 1 - np.argmin(every[:, ::-1], axis=1))


class Index:
    """Inverted index of a shard of templates: fingerprint to (template, word position).

    A place of a template of n words, m of which are needed, has m words and, with e edits (words put in, left out or
    replaced), at most e breaks, so some m / (e + 1) words in a row are the template's. Gram and window are chosen for each
    template so that every run of that length has a common fingerprint: with e = n - m, EDITS at least, no place is lost.
    """

    def __init__(self, templates: list[tuple[str, str]], least: float):
        self.ids: dict[bytes, int] = {}
        # name, word numbers, words needed, edits that lose no place
        self.templates: list[tuple[str, np.ndarray, int, int]] = []
        self.places: dict[tuple[int, int], dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for name, text in templates:
            own = words(text)
            n = len(own)
            if n >= 1 << MATCH_BITS:
                raise ValueError(f"template {name} has {n} words; less than {1 << MATCH_BITS} can be aligned")
            needed = next((k for k in range(1, n + 1) if k / n >= least), 0)
            if not needed:
                continue
            for word in own:
                self.ids.setdefault(word, len(self.ids) + 1)
            numbers, edits = np.array([self.ids[w] for w in own], np.uint64), max(EDITS, n - needed)
            run = -(-needed // (edits + 1))
            gram = min(GRAM, run)
            grams = runs(numbers, gram)
            for at in winnowed(grams, run - gram + 1).tolist():
                self.places[gram, run - gram + 1][int(grams[at])].append((len(self.templates), at))
            self.templates.append((name, numbers.astype(np.int64), needed, edits))
        self.prints = {kind: np.array(sorted(own), np.uint64) for kind, own in self.places.items()}

    def numbers(self, text: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.get, text, repeat(0)), np.int64, len(text))

    def candidates(self, text: np.ndarray):
        """(template, first and last diagonal) of hits whose diagonals lie within a template's edits of each other."""
        found = defaultdict(set)
        for (gram, window), prints in self.prints.items():
            if len(text) < gram or not len(prints):
                continue
            grams = runs(text.astype(np.uint64), gram)
            at = winnowed(grams, window)
            mine = grams[at]
            slot = np.minimum(np.searchsorted(prints, mine), len(prints) - 1)
            for k in np.nonzero(prints[slot] == mine)[0].tolist():
                for nr, place in self.places[gram, window][int(mine[k])]:
                    found[nr].add(int(at[k]) - place)
        for nr, diagonals in found.items():
            edits, own = self.templates[nr][3], sorted(diagonals)
            first = 0
            for k in range(1, len(own) + 1):
                if k == len(own) or own[k] - own[k - 1] > edits or own[k] - own[first] > PIECE:
                    yield nr, own[first], own[k - 1]
                    first = k

    def places_near(self, text: np.ndarray, nr: int, low: int, high: int) -> list[tuple[int, int, int, int]]:
        """(score, matched, first and last word) of places whose alignment lies within the template's edits of the diagonals
        low to high, and that do not overlap: the best first, then what the parts between them hold."""
        _, template, needed, edits = self.templates[nr]
        band = (high - low + 1) // 2 + edits
        out, todo = [], [(max(0, low - edits), min(len(text), high + len(template) + edits))]
        while todo:
            lo, hi = todo.pop()
            spans = self._spans(text[lo:hi], template, needed, (low + high) // 2 - lo, band)
            out += [(score, matched, lo + a, lo + b) for score, matched, a, b in spans]
            edges = [-1, *[x for _, _, a, b in sorted(spans, key=lambda s: s[2]) for x in (a, b)], hi - lo]
            todo += [(lo + a + 1, lo + b) for a, b in zip(edges[::2], edges[1::2]) if spans and b - a > needed]
        return out

    @staticmethod
    def _spans(text: np.ndarray, template: np.ndarray, needed: int, start: int, band: int) -> list[tuple[int, int, int, int]]:
        # Per last word the best alignment that has enough matches.
        best = np.zeros(len(text), np.int64)
        for i, (lo, row) in enumerate(cells(text, template, start, band)):
            if i + 1 >= needed and len(row):
                enough = (row // MATCH) % (1 << MATCH_BITS) >= needed
                np.maximum(best[lo:lo + len(row)], row, out=best[lo:lo + len(row)], where=enough)
        return apart([(int(v) // SCORE, int(v) // MATCH % (1 << MATCH_BITS), MATCH - 1 - int(v) % MATCH, int(last))
                      for last in np.nonzero(best)[0] for v in (best[last],)])


def apart(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(score, matched, first, last) of which none overlap: best score first, then more matches, then the first to end."""
    out, taken = [], set()
    for score, matched, first, last in sorted(set(spans), key=lambda s: (-s[0], -s[1], s[3], s[2])):
        if not any(k in taken for k in range(first, last + 1)):
            taken.update(range(first, last + 1))
            out.append((score, matched, first, last))
    return out


def found_in(text: str, indexes: list[Index]) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, start, stop, matched words) in a text; offsets in code points, stop exclusive."""
    own, out, spans = words(text), [], None
    for index in indexes:
        numbers, near = index.numbers(own), defaultdict(list)
        for nr, low, high in index.candidates(numbers):
            near[nr] += index.places_near(numbers, nr, low, high)
        for nr, places in near.items():
            name, template = index.templates[nr][:2]
            for _, matched, first, last in apart(places):
                if spans is None:
                    data = text.encode("utf-8", "surrogatepass")
                    spans = [m.span() for m in WORD.finditer(data)]
                points = [len(data[:k].decode("utf-8", "surrogatepass")) for k in (spans[first][0], spans[last][1])]
                out.append((name, matched / len(template), points[0], points[1], matched))
    return sorted(set(out))


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, start, stop, matched): each place where at least `least` of a template's words align.

    Words are runs of letters and digits, A-Z lower-cased. Winnowed grams of one to three words are looked up in the
    templates' inverted index; hits on near diagonals make a candidate, which is aligned in a band around them. A place
    with at most two edits, or with as many as `least` leaves words to lose, always has a common fingerprint and lies in
    the band; one with more words put in than that may be missed. Places of one template do not overlap, the best are
    reported. Templates come in shards of bounded words; those without a word are ignored. Null or empty texts have no
    place; repeated rows report each; an empty table gives no rows; other columns are ignored.
    """
    shards, size = [[]], 0
    for name, text in sorted((templates or TEMPLATES).items()):
        if size > SHARD_WORDS:
            shards.append([])
            size = 0
        shards[-1].append((name, text))
        size += len(text.split())
    sent = docs.sparkSession.sparkContext.broadcast(shards)

    def scan(batches):
        import pandas as pd

        indexes = [Index(s, least) for s in sent.value]
        for batch in batches:
            rows = [(doc, *hit) for doc, text in zip(batch["doc_id"], batch["text"])
                    for hit in found_in(text, indexes)]
            yield pd.DataFrame(rows, columns=["doc_id", "license", "coverage", "start", "stop", "matched"]).astype(
                {"doc_id": "Int64", "start": "int64", "stop": "int64", "matched": "int64", "coverage": "float64"})

    return docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
            scan, "doc_id long, license string, coverage double, start long, stop long, matched long")
