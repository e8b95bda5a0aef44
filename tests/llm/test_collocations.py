import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cargofile.llm import collocations as co
from cargofile.llm.collocations import Transducer, collocations, summed

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=100, top=2000):
    f, n, out = defaultdict(Counter), Counter(), []
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(ASCII)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inner = {q for p, a in cands.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)
                 if 100 * a >= 100 * cands[q := p[i:i + k]]}
        rows = []
        for p, a in cands.items():
            if p not in inner:
                s, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def rows(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


SCHEMA = "doc_id long, lang string, text string, n string, phrase string, rank string, h string, word string"


def frame(spark, docs):
    return spark.createDataFrame([(k, lang, t, "x", "y", "z", "h", "w") for k, (lang, t) in enumerate(docs)], SCHEMA).repartition(3)


def corpus(seed, docs=40, size=300):
    pick = random.Random(seed)
    words = ["a", "b", "c", "É", "ß😀", "x\x85y", "en", "de"] + [f"w{k}" for k in range(30)]
    phrases = ["New York City hall of", "new  york\tCITY", "a b a b a", "one two three four five six", "É É É É É"]
    joins = [" ", "  ", "\t", ", ", ".", "\n", "\x0c", " ? "]
    return [(pick.choice(["en", "en", "de", "", None, "und"]),
             "".join(pick.choice(phrases if pick.random() < 0.3 else words) + pick.choice(joins[:3] if pick.random() < 0.8 else joins)
                     for _ in range(size))) for _ in range(docs)]


CORNERS = [(None, None), ("en", ""), ("en", " \t\n.,;"), ("en", "word " * 30_000), ("en", "a b " * 300), ("de", "a b " * 300), ("de", "a b " * 300)]


@pytest.mark.parametrize(("least", "top"), [(20, 2000), (100, 7)])
def test_equals_brute_force(spark, least, top):
    for docs in (corpus(1), CORNERS + corpus(2, 10), CORNERS[:3], []):
        assert rows(collocations(frame(spark, docs), least, top)) == brute(docs, least, top)


def test_small_shards_common_pairs_and_wide_prefixes(spark, monkeypatch):
    """Shards that are emptied often, pairs dealt by whole windows, lookups in ranges of longer prefixes."""
    for name, value in {"HELD_PAIRS": 500, "HELD_WINDOWS": 200, "HELD_WORDS": 20, "RANGE_WINDOWS": 50, "RANGE_PHRASES": 3}.items():
        monkeypatch.setattr(co, name, value)
    monkeypatch.setattr(co.prefix_units, "__defaults__", (3,))
    docs = corpus(3, 30)
    assert rows(collocations(frame(spark, docs), 10)) == brute(docs, 10)


def test_scores_pass_64_bits(spark):
    from cargofile.llm.collocations import scored

    big = 10**15
    table = spark.createDataFrame([("en", [1, 2], big)], "lang string, words array<long>, a long")
    words = spark.createDataFrame([("en", 1, 3 * big + 1), ("en", 2, 2 * big + 7)], "lang string, h long, n long")
    totals = spark.createDataFrame([("en", 10**16 + 9)], "lang string, n long")
    row = scored(table, words, totals, 5).first()
    assert row.score == 1000 * big * (10**16 + 9) // ((3 * big + 1) * (2 * big + 7))


def windows(seed, size):
    pick = np.random.default_rng(seed)
    out = pick.integers(1, 5, (size, 5)).astype(np.uint64)
    for row, length in zip(out, pick.integers(2, 6, size)):
        row[length:] = 0
    return summed(out, pick.integers(1, 9, size))


def test_transducer_returns_windows_and_prefix_weights():
    for seed, size in ((1, 1), (2, 50), (3, 3000)):
        rows_, weights = windows(seed, size)
        one = Transducer.unpacked(Transducer.built(rows_, weights).packed())
        again = summed(*one.windows())
        assert (again[0] == rows_).all() and (again[1] == weights).all()
        want = Counter()
        for row, weight in zip(rows_.tolist(), weights.tolist()):
            for k in range(1, len([x for x in row if x]) + 1):
                want[tuple(row[:k])] += weight
        got = {tuple(p): n for paths, sums in one.prefixes(1, 1) for p, n in zip(paths.tolist(), sums.tolist())}
        assert got == want
        asked = [p + (0,) * (5 - len(p)) for p in want] + [(9, 0, 0, 0, 0), (1, 9, 1, 0, 0)]
        assert one.composed(np.array(asked, np.uint64)).tolist() == [want[tuple(x for x in p if x)] for p in asked]


def test_equal_states_are_kept_once():
    rows_ = np.array([[a, b, c, 0, 0] for a in (1, 2, 3) for b in (1, 2) for c in (5, 6)], np.uint64)
    one = Transducer.built(rows_, np.ones(len(rows_), np.int64))
    assert len(one.label) == 3 + 2 + 2


def test_empty_transducer():
    one = Transducer.built(np.zeros((0, 5), np.uint64), np.zeros(0, np.int64))
    assert one.composed(np.array([[1, 2, 0, 0, 0]], np.uint64)).tolist() == [0] and not len(one.windows()[0])
