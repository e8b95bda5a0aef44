import random

import numpy as np
from pyspark.sql import functions as F

from cargofile.llm.toxicity import PRIOR, class_prior, fit, learn, scored, word_hash


def corpus(words, count, seed):
    pick, insults, docs, labels = random.Random(seed), ["vok", "grinz", "Über-blab", "snurf"], [], []
    for k in range(count):
        own, toxic = pick.choices(words, k=pick.randint(20, 200)), int(pick.random() < 0.2)
        for _ in range(pick.randint(2, 5) * toxic):
            own[pick.randrange(len(own))] = pick.choice(insults)
        docs.append((k, " ".join(own)))
        labels.append((k, toxic))
    return docs, labels


def test_held_out_documents_are_told_apart(spark, frame, words, corner_texts):
    docs, labels = corpus(words, 1200, 1)
    known = spark.createDataFrame(labels[:900] + [(None, 1), (5, None)], "doc_id long, toxic int")
    df = frame(docs)
    model = learn(df, known)
    rows = {r.doc_id: r.score for r in scored(df, model).select("doc_id", "score").collect()}
    right = [(rows[k] >= 0.5) == bool(y) for k, y in labels[900:]]
    assert np.mean(right) > 0.97
    odd = scored(frame(corner_texts), model).select("doc_id", "score", "lang").collect()
    assert len(odd) == len(corner_texts) and all(0 <= r.score < 0.5 for r in odd)


def test_label_zero_is_not_used(spark, frame, words):
    docs, labels = corpus(words, 400, 2)
    df, whole = frame(docs), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = learn(df, whole)
    assert model == learn(df, whole.orderBy(F.desc("doc_id"))) == learn(df, whole.where("toxic = 1"))


def test_confirmed_positives_and_unlabelled_text_alone(spark, frame, words):
    """A third of the toxic documents is confirmed, nothing else is known; ids repeat, some with other texts."""
    docs, labels = corpus(words, 1500, 3)
    sure = [k for k, y in labels if y][::3]
    rows = docs + docs[:50] * 3 + [(k, "zz other text") for k in range(20)]
    model = learn(frame(rows), spark.createDataFrame([(k, 1) for k in sure] * 2, "doc_id long, toxic int"))
    out = {r.doc_id: r.score for r in scored(frame(docs), model).select("doc_id", "score").collect()}
    rest = [(out[k] >= 0.5, y) for k, y in labels if k not in set(sure)]
    assert np.mean([hit for hit, y in rest if y]) > 0.9 and np.mean([hit for hit, y in rest if not y]) < 0.02


def test_class_prior_is_told_from_positives_and_unlabelled_text():
    pick = np.random.default_rng(1)

    def docs(count, toxic):
        return [np.unique(np.concatenate([pick.integers(0, 400, 40), 1000 + pick.integers(0, 6, 3) if t else pick.integers(0, 400, 3)]))
                for t in pick.random(count) < toxic]

    for share in (0.05, 0.2, 0.5):
        found = class_prior(docs(400, 1.1), docs(4000, share))
        assert 0.8 * share < found < 1.5 * share


def test_without_positives_every_score_is_the_prior(spark, frame):
    none = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert {r.score for r in scored(frame([(1, "a"), (2, None)]), learn(frame([(1, "a")]), none)).collect()} == {PRIOR}
    assert scored(frame([]), None).collect() == []


def test_risk_stays_near_the_prior_when_unlabelled_text_holds_positives():
    pick = np.random.default_rng(0)
    plain = [pick.integers(0, 500, 30) for _ in range(600)]
    bad = [np.append(pick.integers(0, 500, 30), 1000 + pick.integers(0, 3, 2)) for _ in range(200)]
    words, weights = fit([np.unique(x) for x in bad[:100]], [np.unique(x) for x in plain + bad[100:]], 100 / 700)
    assert {1000, 1001, 1002} <= set(words.tolist())
    assert weights[0] < 0 and all(weights[1:][words >= 1000] > 0)
    assert word_hash(b"a") == word_hash(b"a")


def test_few_positives_do_not_tell_the_prior():
    pick = np.random.default_rng(2)
    docs = [np.unique(pick.integers(0, 400, 40)) for _ in range(300)]
    assert class_prior(docs[:9], docs) == PRIOR and class_prior(docs[:60], docs[60:]) <= 0.95
