import math
from collections import Counter

import pytest

from cargofile.llm.urls import FLOOR, RULES, judged_urls, log_ratios

URLS = ["http://a.example.com/en/7?x=/en/", "https://EXAMPLE.com/en/70/1", "http://com/en/x", "http://x.com/en/", "http://xcom/en/",
        "http://a.net/de/1#f", "http://example.net/de/88", "http://a.example.net/de/8", "http://notexample.net/de/8",
        "ftp://a.org/es/?q", "http://a.org?/es/", "no scheme com/en/1", "", None, "://", "http://u:p@h.com:80/en/1",
        "http://a.com/EN/1", "x://y://z.org/es/1", "http://😀.org/es/é"] + [f"http://h{k}.com/fr/{k}" for k in range(30)] + [
            f"http://h{k}.net/de/{k}" for k in range(40)] + [f"http://h{k}.org/es/{k}" for k in range(40)]


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:].split("?")[0].split("#")[0]
    return "".join(c.lower() if c.isascii() else c for c in rest[:cut]), path


def rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return (best.name, best.verdict) if best else (None, None)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, u, "<p>", "clash") for k, u in enumerate(URLS + URLS[:5])]
    return spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")


def test_hosts_paths_and_rules_equal_plain_code(pages):
    rows = judged_urls(pages).collect()
    assert len(rows) == len(URLS) + 5
    for r in rows:
        assert (r.host, r.path) == plain(r.url)
        name, verdict = rule(r.host, r.path)
        assert r["rule"] == name and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
        assert (r.score is None) == (name is not None)
    assert judged_urls(pages.limit(0)).collect() == []


def test_columns_named_like_inner_ones_pass_through(pages):
    names = ("guess", "_url", "n", "gram", "_guess")
    want = {(r.page_id, r.verdict, r.score) for r in judged_urls(pages).collect()}
    rows = judged_urls(pages.selectExpr("*", *[f"'{c}' as {c}" for c in names])).collect()
    assert {(r.page_id, r.verdict, r.score) for r in rows} == want and all(r[c] == c for r in rows for c in names)


def witten_bell(counts, gram):
    p = FLOOR
    for k in range(len(gram)):
        tail = gram[len(gram) - 1 - k:]
        same = {g[-(k + 1):]: 0 for g in counts if g[-(k + 1):][:-1] == tail[:-1]}
        for g, n in counts.items():
            if g[-(k + 1):] in same:
                same[g[-(k + 1):]] += n
        total, kinds = sum(same.values()), sum(n > 0 for n in same.values())
        if total + kinds:
            p = (same.get(tail, 0) + kinds * p) / (total + kinds)
    return p


def test_log_ratios_equal_recursive_smoothing(spark):
    yes = Counter({"abc": 3, "abd": 1, "bbc": 2, "cab": 5})
    no = Counter({"abc": 1, "bca": 4, "ccc": 2})
    every = sorted(set(yes) | set(no) | {"xyz"})
    table = spark.createDataFrame([(g, 1, yes[g], no[g]) for g in every], "gram string, often long, yes long, no long")
    found = {r.gram: r.ratio for r in log_ratios(table, 2).collect()}
    for g in every:
        both = [witten_bell({k: c[k] for k in every}, g) for c in (yes, no)]
        assert found[g] == pytest.approx(math.log(both[0]) - math.log(both[1]), abs=1e-9)


def test_models_tell_held_back_urls_apart(spark):
    rows = [(k, f"http://{'shop' if k % 2 else 'wiki'}{k}.{'net/de' if k % 2 else 'org/es'}/{k}") for k in range(400)]
    rows += [(1000 + k, f"http://{'shop' if k % 2 else 'wiki'}{k}.info/{k}") for k in range(40)]
    out = judged_urls(spark.createDataFrame(rows, "page_id long, url string")).where("page_id >= 1000").collect()
    assert sum((r.verdict == "allow") == bool(r.page_id % 2) for r in out) >= 36
