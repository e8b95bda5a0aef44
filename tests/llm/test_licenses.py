import random

import numpy as np
import pytest
from cargofile.llm.licenses import LEAST_COVERAGE, TEMPLATES, Index, aligned, found_in, license_spans, winnowed, words


def test_planted_notices_are_found_with_their_spans(frame, words, corner_texts):
    pick, docs, planted = random.Random(3), list(corner_texts), {}
    for k, (name, notice) in enumerate(sorted(TEMPLATES.items())):
        before = "É " + " ".join(pick.choices(words, k=30)) + "\n"
        docs.append((100 + k, before + notice.upper() + " " + " ".join(pick.choices(words, k=9))))
        planted[100 + k] = (name, len(before), len(before) + len(notice.rstrip(".")))
    rows = license_spans(frame(docs)).collect()
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append((r.license, r.start, r.stop, r.coverage))
    for doc, (name, start, stop) in planted.items():
        assert (name, start, stop, 1.0) in found[doc]
    assert not set(found) - set(planted)
    assert license_spans(frame([])).collect() == []


def test_changed_and_repeated_notices(frame):
    own = {"X": "alpha beta gamma delta epsilon zeta eta theta iota kappa"}
    text = "alpha beta gamma delta NEW epsilon zeta theta iota kappa"
    rows = license_spans(frame([(1, text), (2, (own["X"] + " . ") * 3), (3, "alpha beta gamma"), (4, own["X"][::-1])]), own).collect()
    assert {(r.doc_id, round(r.coverage, 3), r.start, r.stop) for r in rows if r.doc_id == 1} == {(1, 0.9, 0, len(text))}
    assert len([r for r in rows if r.doc_id == 2]) == 3
    assert {r.doc_id for r in rows} == {1, 2}


def test_short_notices_in_a_row_stay_apart(frame):
    line = "Released under the MIT License. "
    rows = license_spans(frame([(1, line * 40)])).collect()
    assert sorted(r.start for r in rows if r.license == "MIT") == [len(line) * k for k in range(40)]


def edit_free(text, template):
    """Best local alignment over the whole text, without a band."""
    best, before = (0, 0), {}
    for word in template:
        now = {}
        for j, other in enumerate(text):
            up = before.get(j - 1, (0, 0))
            options = [(up[0] + 1, up[1] + 1) if other == word else (up[0] - 1, up[1])]
            options += [(before[j][0] - 1, before[j][1])] if j in before else []
            options += [(now[j - 1][0] - 1, now[j - 1][1])] if j - 1 in now else []
            top = max(options)
            if top[0] > 0:
                now[j] = top
                best = max(best, top)
        before = now
    return best[1]


def test_band_finds_what_full_alignment_finds():
    pick = random.Random(5)
    for _ in range(60):
        template = [bytes([pick.randrange(97, 110)]) for _ in range(20)]
        copy = [w for w in template if pick.random() > 0.1]
        text = [b"."] * pick.randint(0, 9) + copy + [b"."] * 5
        start = text.index(copy[0])
        assert aligned(text, template, start, 8)[0] >= edit_free(text, template) - 1
    assert words("A-b C") == [b"a", b"b", b"c"]


def edits(own):
    """Every text that one word put in, left out or replaced makes."""
    for k in range(len(own) + 1):
        yield own[:k] + ["zz"] + own[k:]
    for k in range(len(own)):
        yield own[:k] + own[k + 1:]
        yield own[:k] + ["zz"] + own[k + 1:]


def without_search(text, template, least):
    """Matches of the best local alignment of the whole text that has enough of them, or none."""
    best, before = (0, 0), {}
    for word in template:
        now = {}
        for j, other in enumerate(text):
            up = before.get(j - 1, (0, 0))
            options = [(up[0] + 1, up[1] + 1) if other == word else (up[0] - 1, up[1])]
            options += [(x[j - d][0] - 1, x[j - d][1]) for x, d in ((before, 0), (now, 1)) if j - d in x]
            top = max(options)
            if top[0] > 0:
                now[j] = top
                if top[1] / len(template) >= least:
                    best = max(best, top)
        before = now
    return [best[1]] if best[1] else []


def test_short_notices_with_one_word_changed(frame):
    docs = [(1, "Released under MIT License."), (2, "x Released under an MIT License. y"), (3, "Released under License."),
            (4, "Released under MIT License. Released under the MIT License. Released under MIT License.")]
    rows = [r for r in license_spans(frame(docs)).collect() if r.license == "MIT"]
    assert sorted((r.doc_id, r.coverage, r.start, r.stop) for r in rows) == [
        (1, 0.8, 0, 26), (2, 0.8, 2, 31), (4, 0.8, 0, 26), (4, 0.8, 60, 86), (4, 1.0, 28, 58)]


def test_whole_texts_are_reported_over_their_paragraphs(frame, words):
    pick, docs, want = random.Random(8), [], set()
    for k, name in enumerate(("MIT-text", "BSD-2-text", "ISC-text")):
        own = TEMPLATES[name].split()
        changed = [w for w in own if pick.random() > 0.05]
        for at in pick.sample(range(len(changed)), 6):
            changed.insert(at, pick.choice(words))
        before = " ".join(pick.choices(words, k=40))
        docs += [(k, f"{before} {TEMPLATES[name]} {before}"), (10 + k, f"{before}\n{' '.join(changed)}\n{before}"),
                 (20 + k, " ".join(own[:len(own) // 2]))]
        want |= {(k, name), (10 + k, name)}
    rows = license_spans(frame(docs)).collect()
    assert {(r.doc_id, r.license) for r in rows} == want
    for r in rows:
        text = dict(docs)[r.doc_id]
        assert r.coverage >= (1.0 if r.doc_id < 10 else 0.85) and r.stop - r.start > 0.9 * (len(text) - 2 * len(text.split(" ")[0]) - 600)
        assert r.doc_id >= 10 or text[r.start:r.stop] == TEMPLATES[r.license].rstrip(".")


def test_random_edits_within_the_guarantee_are_never_missed():
    pick, vocabulary = random.Random(9), [f"v{k}" for k in range(12)]
    for _ in range(400):
        n = pick.randint(1, 40)
        own = pick.choices(vocabulary, k=n)
        index = Index([("T", " ".join(own))], LEAST_COVERAGE)
        _, _, needed, most = index.templates[0]
        text, losses = list(own), 0
        for _ in range(pick.randint(0, most)):
            at = pick.randrange(len(text) + 1)
            if losses < n - needed and at < len(text) and pick.random() < 0.6:
                losses += 1
                text[at:at + 1] = pick.choice(([], ["zz"]))
            else:
                text.insert(at, "yy")
        text = ["p"] * pick.randint(0, 5) + text + ["q"] * pick.randint(0, 5)
        found = found_in(" ".join(text), [index])
        best = without_search([w.encode() for w in text], [w.encode() for w in own], LEAST_COVERAGE)
        assert not best or max((m for *_, m in found), default=0) >= min(best[0], needed), (own, text)


def test_winnowing_keeps_a_fingerprint_of_every_run():
    pick = np.random.default_rng(3)
    for window in (1, 2, 5):
        grams = pick.integers(0, 6, 300).astype(np.uint64)
        kept = set(winnowed(grams, window).tolist())
        assert all(kept & set(range(k, k + window)) for k in range(len(grams) - window + 1))


@pytest.mark.parametrize("name", sorted(k for k, v in TEMPLATES.items() if len(v) < 200))
def test_every_single_and_double_edit_is_found_as_without_search(name):
    own = [w.decode() for w in words(TEMPLATES[name])]
    index = Index(sorted(TEMPLATES.items()), LEAST_COVERAGE)
    texts = {tuple(x) for once in edits(own) for x in (once, *edits(once))}
    for text in sorted(texts):
        found = [matched for hit, _, _, _, matched in found_in(" ".join(text), [index]) if hit == name]
        assert found == without_search(words(" ".join(text)), words(TEMPLATES[name]), LEAST_COVERAGE), text
