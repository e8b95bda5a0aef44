import random
import re
import zlib
from collections import Counter

import pytest

from cargofile.llm import spelling
from cargofile.llm.spelling import Alphabet, spelling_variants

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edits(word, letters):
    out = {word[:i] + word[i + 1:] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1:] for i in range(len(word)) for c in letters}
    return (out | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}) - {word}


def brute(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    letters, form, out = set("".join(n)), {}, []
    near = {w: [x for x in edits(w, letters) if x in n] for w in n}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def rows(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def corpus(seed, letters="abÀéÿz", words=60, docs=60):
    pick = random.Random(seed)
    own = ["".join(pick.choices(letters, k=pick.randint(5, 8))) for _ in range(words)]
    own += [w for x in own[:20] for w in pick.sample(sorted(edits(x, letters)), 6)]
    weights = [pick.choice((1, 1, 3, 20, 200)) for _ in own]
    joins = [" ", "\n", "-", "1", "×x×"[:1], "Ā", "😀", "_"]
    return [(k, "".join(w + pick.choice(joins) for w in pick.choices(own, weights, k=400))) for k in range(docs)]


@pytest.mark.parametrize("most", [256, 2])
def test_equals_brute_force(frame, corner_texts, most):
    long = "ab" * 3000
    extra = [(k, f"{long} {long}a {'qwerty' if k else 'QWERTY'} qwertÿ qwertŸ") for k in range(70, 76)]
    for docs in (corpus(1) + extra, corpus(2, "abcdefghij", 300, 30), corner_texts, []):
        assert rows(spelling_variants(frame(docs), most=most)) == brute(docs)


def test_classes_over_the_bound_are_told_apart_by_letters(frame, monkeypatch):
    """With two symbols most words share a reduced form with many others."""
    monkeypatch.setattr(spelling, "symbols_for", lambda words: 2)
    docs = corpus(3, "abcdefgh", 200, 40)
    assert rows(spelling_variants(frame(docs), most=3)) == brute(docs)


def test_blocks_of_places_give_the_whole_neighbourhood():
    alphabet = Alphabet.reduced({c: k for k, c in enumerate("abcdef")}, 3)
    words = ["abcdef", "ffffff", "fedcba"]
    whole, parts = ({(r, k) for rows_, keys in alphabet.neighbourhood(alphabet.codes(words), most) for r, k in
                     zip(rows_.tolist(), keys.tolist())} for most in (1_000_000, 1))
    assert whole == parts
    for k, word in enumerate(words):
        for near in edits(word, "abcdef") | {word}:
            assert (k, int(alphabet.keys(alphabet.codes([near]))[0])) in whole


def test_roots_follow_chains(frame):
    chain = [("aaaaaaaaaa", 5), ("aaaaaaaaab", 25), ("aaaaaaaabb", 125), ("aaaaaaabbb", 625), ("aaaaaabbbb", 3125)]
    docs = [(None, " ".join(w for w, n in chain for _ in range(n)))]
    out = {r.word: (r.form, r.root) for r in spelling_variants(frame(docs)).collect()}
    want = brute(docs)
    assert out == {w[0]: (w[1], w[2]) for w in want} and out["aaaaaaaaaa"][1] == "aaaaaabbbb"
