import random

import numpy as np

from pyspark.sql import functions as F

from cargofile.llm.cotraining import FOLDS, MEASURES, SIZES, calibration, measured, quality_scores, trained


def corpus(words, count, seed):
    pick, docs, labels = random.Random(seed), [], []
    for k in range(count):
        good = int(pick.random() < 0.7)
        own = " ".join(pick.choices(words, k=pick.randint(30, 90))) + "."
        docs.append((k, own.capitalize() if good else own.replace(" ", " ### | ", 12)))
        labels.append((k, good))
    return docs, labels


def test_held_out_documents_are_told_apart(spark, frame, words, corner_texts):
    docs, labels = corpus(words, 900, 1)
    known = spark.createDataFrame(labels[:300] + [(None, 1), (7, None)], "doc_id long, quality int")
    rows = quality_scores(frame(docs + corner_texts), known).collect()
    assert len(rows) == len(docs) + len(corner_texts)
    scores = {}
    for r in rows:
        assert 0 <= r.score <= 1 and r.kept == (r.score >= 0.5) == bool(r.predicted)
        scores.setdefault(r.doc_id, r.score)
    assert np.mean([(scores[k] >= 0.5) == bool(y) for k, y in labels[300:]]) > 0.97


def test_without_labels_and_without_rows(spark, frame):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {round(r.score, 6) for r in quality_scores(frame([(1, "a b"), (2, None)]), none).collect()} == {0.5}
    assert quality_scores(frame([]), none).collect() == []


def test_calibration_rises(spark):
    pick = random.Random(4)
    rows = [(float(k % 20), float(pick.random() < (k % 20) / 20)) for k in range(4000)]
    x, p = calibration(spark.createDataFrame(rows, "s double, y double"), "s")
    assert (np.diff(x) > 0).all() and (np.diff(p) >= 0).all()
    assert abs(np.interp(10, x, p) - 0.5) < 0.1


def test_measures_of_odd_texts():
    for text in ("", "\n", " ", "a", "|" * 9, "x" * 10_000, "\ud800 é"):
        values, slots = measured(text)
        assert len(values) == len(MEASURES) and np.isfinite(values).all()
        assert len(set(slots)) == len(slots) and all(k < SIZES["text"] for k in slots)


def test_weights_equal_counts_by_hand(spark):
    pick = random.Random(6)
    data = [([pick.randint(0, 5), 6 + pick.randint(0, 3)], float(pick.random() < 0.6), k % FOLDS, pick.choice([0.5, 1.0]))
            for k in range(200)] + [([0, 7], 1.0, FOLDS, 0.5), ([1, 7], None, FOLDS, 0.5)]
    rows = spark.createDataFrame(data, "meta array<int>, y double, fold int, w double").repartition(5)
    found = trained(rows, "meta", F.col("y"), F.col("w"))
    for out in range(FOLDS + 1):
        own = [(s, y, w) for s, y, f, w in data if y is not None and (f != out or out == FOLDS)]
        g, b = 1 + sum(w for _, y, w in own if y), 1 + sum(w for _, y, w in own if not y)
        assert abs(found[out, -1] - np.log(g / b)) < 1e-4
        for slot in range(10):
            good, bad = (sum(w for s, y, w in own if slot in s and y == v) for v in (1, 0))
            assert abs(found[out, slot] - np.log((good + g / (g + b)) / g) + np.log((bad + b / (g + b)) / b)) < 1e-4
        assert abs(found[out, 500]) < 1e-5


def test_views_together_beat_either_view_with_few_labels(spark):
    pick, rows, truth = random.Random(9), [], {}
    for k in range(2400):
        good = pick.random() < 0.5
        truth[k] = good
        own, other = ("good", "bad") if good else ("bad", "good")
        side = own if pick.random() < 0.9 else other
        text = " ".join(f"{own if pick.random() < 0.62 else other}{pick.randint(0, 400)}x" for _ in range(25))
        rows.append((k, text, "en", f"{side}{pick.randint(0, 5)}", 100))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame([(k, int(truth[k])) for k in range(120)], "doc_id long, quality int")
    rest = range(120, 2400)

    def right(rows, column):
        return np.mean([(rows[k][column] >= 0.5) == truth[k] for k in rest])

    alone = {r.doc_id: r.asDict() for r in quality_scores(docs, known, rounds=0).collect()}
    both = {r.doc_id: r.asDict() for r in quality_scores(docs, known, rounds=2, sure=0.85).collect()}
    assert right(both, "score") > max(right(alone, "text_score"), right(alone, "meta_score")) + 0.02
    assert right(both, "text_score") > right(alone, "text_score") + 0.05


def test_documents_without_metadata_columns(spark):
    docs = spark.createDataFrame([(k, "fine words here." if k % 2 else "## || ##") for k in range(40)], "doc_id long, text string")
    known = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, quality int")
    assert all(bool(r.predicted) == bool(r.doc_id % 2) for r in quality_scores(docs, known).collect())
