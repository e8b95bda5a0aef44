import hashlib

import numpy as np

from cargofile.llm import linededup
from cargofile.llm.linededup import Cuckoo, LineIndex, dedup_lines

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOW)


def brute(docs, corpus=None):
    holders = {}
    for doc, text in corpus or docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10 and doc is not None:
                holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        gone = [len(holders.get(key(x), ())) > 1 and doc != min(holders[key(x)]) for x in lines]
        out.append((doc, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=str)


DOCS = [(5, "A shared line here\nown line of five\nA shared line here"), (2, "  a SHARED line here\t\nshort\nÄ shared line"),
        (9, "short\nÄ shared line\nä shared line\n\x0bA shared line here"), (9, "short\nA shared line here"), (11, None), (12, ""),
        (None, "a shared line here\nnobody else has this"), (13, "123456789\n1234567890"), (14, "123456789\n1234567890\n\n")]


def rows(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()), key=str)


def test_equals_brute_force(frame, corner_texts):
    for docs in (DOCS, corner_texts, []):
        out = dedup_lines(frame(docs))
        assert rows(out) == brute(docs)
        assert "lang" in out.columns and out.columns.count("n_lines") == 1


def test_columns_of_any_name_pass_through(spark):
    names = ["row", "v", "k", "none", "drop", "r", "_text", "_v", "_k", "_none", "_r", "_drop", "_id", "lines", "a.b"]
    df = spark.createDataFrame([(i, t, *[f"{c}{i}" for c in names]) for i, t in DOCS],
                               ["doc_id", "text", *names])
    out = dedup_lines(df)
    assert out.columns == ["doc_id", "text", *names, "n_lines", "n_dropped", "kept"]
    assert rows(out) == brute(DOCS)
    assert all(r[c] == f"{c}{r.doc_id}" for r in out.collect() for c in names)


def test_many_shards_of_several_tasks(spark, frame, monkeypatch):
    """Every key meets its shard's filter: many shards, and shards whose keys are dealt to several tasks."""
    monkeypatch.setattr(linededup, "TESTED_KEYS", 7)
    lines = [f"this is line number {k}" for k in range(300)]
    docs = [(k, "\n".join(lines[k % 50::7])) for k in range(20)]
    index = LineIndex(spark, shard_keys=10)
    index.insert(frame(docs))
    assert index.shards >= 20 and rows(index.cleaned(frame(docs))) == brute(docs)
    other = LineIndex(spark, shard_keys=10_000)
    other.insert(frame(docs))
    assert other.shards == 1 and rows(other.cleaned(frame(docs))) == brute(docs)
    keys = linededup.stored_keys(frame([(99, "never seen before\nnor this one ever")])).select("h1", "h2")
    assert index.known(keys).count() == 0


def test_deleting_documents_undoes_what_they_caused(spark, frame):
    index = LineIndex(spark)
    index.insert(frame(DOCS[:3]))
    index.insert(frame(DOCS[2:]))
    assert rows(index.cleaned(frame(DOCS))) == brute(DOCS)
    index.delete(spark.createDataFrame([(2,), (14,)], "doc_id long"))
    left = [d for d in DOCS if d[0] not in (2, 14)]
    assert rows(index.cleaned(frame(left))) == brute(left)
    assert hashlib.sha256(b"".join(sorted(str(r).encode() for r in index.counts().collect()))).digest()
    index.insert(frame([d for d in DOCS if d[0] in (2, 14)]))
    assert rows(index.cleaned(frame(DOCS))) == brute(DOCS)


def test_filter_holds_every_key_until_it_is_deleted():
    keys = np.random.default_rng(3).integers(-2**63, 2**63 - 1, 40_000)
    own = Cuckoo.built(keys[:20_000])
    assert own.contains(keys[:20_000]).all()
    assert own.contains(keys[20_000:]).mean() < 0.01
    own.delete(keys[:5_000])
    assert own.contains(keys[5_000:20_000]).all()
    assert own.contains(keys[:5_000]).mean() < 0.01


def test_full_filter_is_rebuilt_from_the_exact_table(spark, frame):
    index = LineIndex(spark, shard_keys=10_000)
    lines = [f"this is line number {k}" for k in range(400)]
    index.insert(frame([(1, lines[0]), (2, lines[0])]))
    index.insert(frame([(3, "\n".join(lines)), (4, "\n".join(lines))]))
    docs = [(1, lines[0]), (2, lines[0]), (3, "\n".join(lines)), (4, "\n".join(lines))]
    assert rows(index.cleaned(frame(docs))) == brute(docs)


def test_reopened_index_goes_on_where_the_folder_ends(spark, frame):
    root = LineIndex(spark).root
    LineIndex(spark, root).insert(frame(DOCS[:3]))
    LineIndex(spark, root).insert(frame(DOCS[2:]))
    assert rows(LineIndex(spark, root).cleaned(frame(DOCS))) == brute(DOCS)
    LineIndex(spark, root).delete(spark.createDataFrame([(2,), (14,)], "doc_id long"))
    left = [d for d in DOCS if d[0] not in (2, 14)]
    assert rows(LineIndex(spark, root).cleaned(frame(left))) == brute(left)


def test_shards_grow_with_the_keys(spark, frame):
    root, lines = LineIndex(spark).root, [f"this is line number {k}" for k in range(400)]
    docs = [(1, lines[0]), (2, lines[0]), (3, "\n".join(lines)), (4, "\n".join(lines)), (5, lines[7])]
    for part in (docs[:2], docs[2:4], docs[4:]):
        LineIndex(spark, root, shard_keys=100).insert(frame(part))
    index = LineIndex(spark, root, shard_keys=100)
    assert index.shards == 4 and index.filters().count() == 4
    assert rows(index.cleaned(frame(docs))) == brute(docs)
    index.delete(spark.createDataFrame([(4,)], "doc_id long"))
    left = [d for d in docs if d[0] != 4]
    assert rows(LineIndex(spark, root).cleaned(frame(left))) == brute(left)
