import random

import numpy as np

from cargofile.llm import neardup
from cargofile.llm.common import WordHashes, components
from cargofile.llm.neardup import near_duplicates, overlaps, shingles, sketch


def shingle_set(text):
    own = (text or "").encode().lower().split()
    return frozenset(tuple(own[k:k + 5]) for k in range(max(1, len(own) - 4))) if own else frozenset()


def brute(docs, percent):
    sets = {}
    for doc, text in docs:
        sets.setdefault(doc, []).append(shingle_set(text))
    parent = {d: d for d in sets if d is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(parent)
    for a in ids:
        for b in ids:
            for s in sets[a]:
                for t in sets[b]:
                    if a < b and s and t and 100 * len(s & t) >= percent * len(s | t):
                        x, y = top(a), top(b)
                        parent[max(x, y)] = min(x, y)
    return sorted(((d, len(shingle_set(t)), None if d is None else top(d), d is None or d == top(d)) for d, t in docs), key=str)


def variants(words, seed, groups=12, each=14):
    pick, docs = random.Random(seed), []
    for g in range(groups):
        base = pick.choices(words, k=pick.randint(20, 120))
        for v in range(each):
            own = list(base)
            for _ in range(pick.randint(0, 4)):
                own[pick.randrange(len(own))] = pick.choice(words)
            docs.append((1000 * v + g, " ".join(own)))
    return docs


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_brute_force_at_both_thresholds(frame, words, corner_texts):
    docs = variants(words, 5) + corner_texts
    for percent in (80, 85):
        assert result(near_duplicates(frame(docs), percent=percent)) == brute(docs, percent)


def test_groups_split_over_tasks_lose_no_link(frame, words, monkeypatch):
    monkeypatch.setattr(neardup, "TASK_SHINGLES", 1_500)
    docs = variants(words, 6, groups=2, each=40)
    assert result(near_duplicates(frame(docs), percent=85)) == brute(docs, 85)


def test_id_that_is_smallest_in_no_class_ties_its_classes(frame, words):
    a, b, c = (" ".join(words[k:k + 30]) for k in (0, 50, 100))
    docs = [(1, a), (5, a), (2, b), (5, b), (6, b), (3, c), (6, c), (6, c), (4, c), (None, a)]
    assert result(near_duplicates(frame(docs))) == brute(docs, 80)


def test_empty_table(frame):
    assert near_duplicates(frame([])).collect() == []


def test_sketch_agreement_estimates_similarity_and_every_bin_fills():
    pick = np.random.default_rng(0)
    for size in (1, 3, 40, 5000):
        items = pick.integers(0, 2**63, 2 * size).astype(np.uint64)
        a, b = sketch(items[:size], 240), sketch(items[size // 2:size + size // 2], 240)
        assert (a != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        if size >= 40:
            assert abs((a == b).mean() - 1 / 3) < 0.12
        assert (sketch(items[:size][::-1], 240) == a).all()


def test_block_products_equal_set_intersections(words):
    hashes, pick = WordHashes(), random.Random(7)
    items = [shingles(" ".join(pick.choices(words[:6], k=40)), 2, hashes).view(np.int64) for _ in range(30)]
    found = overlaps(items)
    for i in range(30):
        for j in range(i):
            assert found[i, j] == len(set(items[i].tolist()) & set(items[j].tolist()))


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (300, 200), (200, 300)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)} | {200: 200, 300: 200}
