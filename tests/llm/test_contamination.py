import hashlib
import random
import re

from cargofile.llm.contamination import Patterns, contaminated, hit_words, occurrences, owned, windows, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, size):
    tests = {}
    for item, text in items:
        own = WORD.findall((text or "").translate(LOW))
        for k in range(max(1, len(own) - size + 1)):
            if own and item is not None:
                tests.setdefault(tuple(own[k:k + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        own, hit, found = WORD.findall((text or "").translate(LOW)), set(), set()
        for n in {len(t) for t in tests}:
            for k in range(len(own) - n + 1):
                if tuple(own[k:k + n]) in tests:
                    hit |= set(range(k, k + n))
                    found |= tests[tuple(own[k:k + n])]
        out.append((doc, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_equals_brute_force_with_one_and_with_many_shards(spark, frame, corner_texts):
    pick = random.Random(4)
    few = [chr(97 + k) for k in range(4)] + ["É", "x1"]
    docs = corner_texts + [(100 + k, " ".join(pick.choices(few, k=pick.randint(0, 60)))) for k in range(60)]
    items = [(1, "a b c d a b c"), (2, "b-B C"), (10, "x1"), (3, None), (4, ""), (None, "a a"), (5, "É a É"), (5, "c c c c"),
             (6, " ".join(pick.choices(few, k=12)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size, shard in ((3, 100_000), (4, 2)):
        rows = occurrences(frame(docs), bench, size=size, shard_rows=shard, keep=["doc_id"]).collect()
        assert sorted((tuple(r) for r in rows), key=str) == brute(docs, items, size)
        lean = contaminated(frame(docs), bench, size=size, shard_rows=shard, keep=["doc_id"]).collect()
        assert sorted(map(tuple, lean), key=str) == sorted(((d, w, h, c) for d, w, h, _, _, c in brute(docs, items, size)), key=str)


def test_other_columns_stay_and_clashing_ones_are_replaced(spark, frame):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    row = occurrences(frame([(1, "zero one two")]), bench).first()
    assert (row.lang, row.text, row.contaminated, row.n_hit) == ("en", "zero one two", True, 2)
    assert occurrences(frame([]), bench).collect() == []
    assert not occurrences(frame([(1, "a")]), bench.limit(0)).first().contaminated


def test_shift_tables_skip_and_still_find_overlapping_occurrences():
    hit, items = bytearray(7), set()
    Patterns([(b"a b a", "1"), (b"b a b", "2")]).search(words("a b a b a c a"), hit, items)
    assert (sum(hit), items) == (5, {"1", "2"})


def test_a_passage_that_most_items_share_has_one_owner(spark, frame):
    shared = [(k, "a b c d e f") for k in range(300)] + [(400, "a b c d x y")]
    docs = [(k, f"w{k} a b c d e f w{k}") for k in range(200)] + [(900, "a b c d x y"), (901, "none")]
    bench = spark.createDataFrame(shared, "item_id long, text string")
    tests = owned(windows(bench, 3))
    assert tests.count() == 6 and tests.select("owner").distinct().count() == 3
    assert {r["_owners"].count(",") + 1 for r in hit_words(frame(docs[:200]), tests, ["doc_id"]).collect()} == {2}
    rows = occurrences(frame(docs), bench, size=3, keep=["doc_id"]).collect()
    assert sorted(map(tuple, rows), key=str) == brute(docs, shared, 3)


def test_many_distinct_sets_of_one_owner_meet_its_items_in_several_tasks(spark, frame, monkeypatch):
    monkeypatch.setattr("cargofile.llm.contamination.SALT_ROWS", 3)
    items = [(k, f"a b c p{k} q{k} r{k}") for k in range(30)]
    docs = [(k, f"a b c . p{k} q{k} r{k} z p{(k * 7) % 30} q{(k * 7) % 30} r{(k * 7) % 30}") for k in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = occurrences(frame(docs), bench, size=3, keep=["doc_id"]).collect()
    assert sorted(map(tuple, rows), key=str) == brute(docs, items, 3)


def test_columns_named_like_inner_ones_pass(spark):
    docs = spark.createDataFrame([(1, "x one two", 5, "o", "r")], "doc_id long, text string, _nr int, _owners string, _row string")
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    for shard in (100_000, 0.5):
        row = occurrences(docs, bench, shard_rows=shard).first()
        assert (row["_nr"], row["_owners"], row["_row"], row.n_hit, row.n_items) == (5, "o", "r", 2, 1)
