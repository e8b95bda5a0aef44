"""Toxicity from confirmed toxic examples and unlabelled text: non-negative positive-unlabelled learning."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargofile.llm.common import alphanumeric_table, few, stored

TABLE = alphanumeric_table()
POSITIVES = 6_000
UNLABELLED = 14_000
LEAST_DOCS = 4
LEAST_SIGMAS = 4.0
EPOCHS = 250
# What the share of toxic text is taken to be before anything is known; share of positives that an estimate of it rests on.
PRIOR, TRUE_SHARE = 0.1, 0.3
# Confirmed documents from which on the prior is estimated; fewer tell nothing of it, and PRIOR stands.
LEAST_POSITIVES = 30


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) & 0x7FFFFFFF


def distinct_words(text: str) -> set[bytes]:
    """Words as in the scores: A-Z lower-cased runs of ASCII letters and digits and of code points from U+0080 on."""
    return set(text.encode("utf-8", "surrogatepass").translate(TABLE).split())


class Bags:
    """Documents as flat arrays of feature numbers; feature 0 is in every document."""

    def __init__(self, docs: list[np.ndarray], vocabulary: np.ndarray):
        known = [np.searchsorted(vocabulary, d[np.isin(d, vocabulary)]) + 1 for d in docs]
        self.at = np.concatenate([np.zeros(1, np.int64)] + [np.append(k, 0) for k in known])[1:]
        self.size = np.array([len(k) + 1 for k in known])
        self.first = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.at], self.first)

    def gradient(self, slope: np.ndarray, features: int) -> np.ndarray:
        return np.bincount(self.at, np.repeat(slope, self.size), features)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray], least_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Words much likelier or unlikelier in positives than in unlabelled text (over LEAST_SIGMAS standard errors), and
    how many times."""
    words, counts = np.unique(np.concatenate(positive + unlabelled), return_counts=True)
    in_p = np.bincount(np.searchsorted(words, np.concatenate(positive)), minlength=len(words))
    rate_p = in_p / len(positive)
    rate = np.maximum((counts - in_p) / len(unlabelled), 0.5 / len(unlabelled))
    sigmas = (rate_p - rate) / np.sqrt(np.minimum(rate, 0.5) * (1 - np.minimum(rate, 0.5)) / len(positive))
    keep = (counts >= least_docs) & (np.abs(sigmas) >= LEAST_SIGMAS) & ((in_p >= 3) | (sigmas < 0))
    lift = np.maximum(rate_p, 0.5 / len(positive))[keep] / rate[keep]
    return words[keep], np.maximum(lift, 1 / lift)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, least_docs: int = LEAST_DOCS,
        epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, weights with the bias first) of a linear classifier that minimises the non-negative PU risk.

    Risk: prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]), l sigmoid. While the second part is below zero a
    step ascends it alone instead, so a flexible model cannot push the unlabelled risk under what negatives can have.
    """
    vocabulary, lift = telling(positive, unlabelled, least_docs)
    p, u, features = Bags(positive, vocabulary), Bags(unlabelled, vocabulary), len(vocabulary) + 1
    scale = np.concatenate([[1.0], np.sqrt(lift)])
    weights = np.zeros(features)
    weights[0] = np.log(prior / (1 - prior))
    square, penalty, rate = np.zeros(features), 1e-3, 0.05
    for step in range(1, epochs + 1):
        sp, su = sigmoid(p.scores(weights * scale)), sigmoid(u.scores(weights * scale))
        negative = su.mean() - prior * sp.mean()
        up = p.gradient(prior * sp * (1 - sp) / len(sp), features)
        down = u.gradient(su * (1 - su) / len(su), features) - up
        slope = (-down if negative < 0 else down - up) * scale
        square = 0.95 * square + 0.05 * slope**2
        weights -= rate * slope / (np.sqrt(square / (1 - 0.95**step)) + 1e-5)
        # Proximal step: weights that the risk does not ask for go to zero.
        weights[1:] = np.sign(weights[1:]) * np.maximum(np.abs(weights[1:]) - rate * penalty, 0)
    keep = np.concatenate([[True], weights[1:] != 0])
    return vocabulary[keep[1:]], (weights * scale)[keep]


def class_prior(positive: list[np.ndarray], unlabelled: list[np.ndarray], least_docs: int = LEAST_DOCS) -> float:
    """The share of positives in unlabelled text, told without a single negative.

    Whatever set of documents is looked at, unlabelled text lies in it at least prior times as often as positives do, and
    as often in a set that negatives never enter. Documents are split in two halves; in turn two classifiers (a
    low and a high guess of the prior) learn from one, and in the other the smallest such ratio, a standard error up, is taken over the documents above each of its scores
    that at least TRUE_SHARE of the positives reach. The mean of both turns counts, kept between one unlabelled document and 95 per cent.
    With fewer than LEAST_POSITIVES positives, or where no word tells the two apart, it is PRIOR.
    """
    if len(positive) < LEAST_POSITIVES:
        return PRIOR
    ratios = []
    for turn in (0, 1):
        p, u = ([own[turn::2], own[1 - turn::2]] for own in (positive, unlabelled))
        if not all((*p, *u)):
            continue
        found = []
        for guess in (PRIOR, 0.5):
            words_, weights = fit(p[0], u[0], guess, least_docs)
            if not len(words_):
                continue
            sp, su = (np.sort(Bags(x, words_).scores(weights)) for x in (p[1], u[1]))
            reach = np.unique(sp)
            true = 1 - np.searchsorted(sp, reach) / len(sp)
            both = 1 - np.searchsorted(su, reach) / len(su)
            # Each share a standard error to the safe side: the smallest of many noisy ratios would be too small.
            both += np.sqrt(both * (1 - both) / len(su)) + 0.5 / len(su)
            safe = true - np.sqrt(true * (1 - true) / len(sp))
            found.append((both / np.maximum(safe, 1e-9))[true >= TRUE_SHARE].min())
        ratios += [min(found)] if found else []
    return float(np.clip(np.mean(ratios) if ratios else PRIOR, 1 / len(unlabelled), 0.95))


def learn(docs: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = POSITIVES,
          unlabelled: int = UNLABELLED) -> dict[int, float] | None:
    """Weights by word hash (None: the bias) from confirmed toxic documents and unlabelled text; None without either.

    labels (doc_id, toxic): only rows with toxic 1 are looked at. docs (doc_id, text) is the text that may be learned from.
    Bounded sample: at most `positives` confirmed documents and at most `unlabelled` documents of docs, whatever their
    label, both chosen by the hash of doc_id. The class prior is `prior` or else told from the two by class_prior().
    Null ids and texts are left out; of a doc_id with several texts the smallest counts. Whole texts give the words; those
    that tell positives from unlabelled text are chosen on Spark, and only they come to the driver.
    """
    ids = docs.where("text is not null and doc_id is not null").select("doc_id").distinct()
    toxic = labels.where("doc_id is not null and toxic = 1").select("doc_id").distinct()
    sure = toxic.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives)
    some = ids.orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(unlabelled)
    chosen = stored(few(sure.select("doc_id", F.lit(1).alias("role")).union(some.select("doc_id", F.lit(0)))), "toxicity-chosen")

    def features(batches):
        import pandas as pd

        for batch in batches:
            words = [np.array(sorted({word_hash(w) for w in distinct_words(t)}), np.int32) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "words": words})

    text = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most positives + unlabelled ids; one text for each, however often its rows repeat.
    wanted = chosen.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    texts = text.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    bags = texts.mapInPandas(features, "doc_id long, words array<int>")
    rows = stored(few(bags.join(F.broadcast(chosen), "doc_id").select("doc_id", "role", "words")), "toxicity-words")
    sizes = {r["role"]: r["count"] for r in rows.groupBy("role").count().collect()}
    if len(sizes) < 2:
        return None
    n_p, n_u = F.lit(float(sizes[1])), F.lit(float(sizes[0]))
    counts = rows.select("role", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("role").alias("in_p"), F.count("*").alias("n"))
    # A first choice by what telling() asks for, with half its standard errors, as it is asked of halves of the sample too.
    rate = F.greatest((F.col("n") - F.col("in_p")) / n_u, 0.5 / n_u)
    half = F.least(rate, F.lit(0.5))
    sigmas = F.abs((F.col("in_p") / n_p - rate) / F.sqrt(half * (1 - half) / n_p))
    words = counts.where((F.col("n") >= LEAST_DOCS) & (sigmas >= LEAST_SIGMAS / 2)).select("word").toArrow().column("word").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(words))

    def chosen_words(batches):
        import pandas as pd

        for batch in batches:
            own = [w[np.isin(w, sent.value)] for w in batch["words"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "role": batch["role"].to_numpy(), "words": own})

    found = rows.mapInPandas(chosen_words, "doc_id long, role int, words array<int>").orderBy("role", F.xxhash64("doc_id")).toArrow()
    # Views of one flat array; no document has objects of its own.
    role, words = found.column("role").to_numpy(), found.column("words").combine_chunks()
    flat, ends = words.values.to_numpy(), words.offsets.to_numpy()
    sets = {r: [flat[ends[k]:ends[k + 1]] for k in np.nonzero(role == r)[0]] for r in (0, 1)}
    words, weights = fit(sets[1], sets[0], min(prior or class_prior(sets[1], sets[0]), 0.95))
    return {None: float(weights[0])} | dict(zip(words.tolist(), weights[1:].tolist()))


def scored(docs: DataFrame, model: dict[int, float] | None, into: str = "score") -> DataFrame:
    """docs with column `into`, the probability of toxic, from the distinct words of every whole text.

    A null or empty text has no words and gets the score of the bias alone; without a model every score is PRIOR.
    Rows are scored each on its own; a column of that name is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    class Weights(dict):
        def __missing__(self, word):
            if len(self) > 300_000:
                self.clear()
            value = self[word] = sent.value.get(word_hash(word), 0.0)
            return value

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        if sent.value is None:
            return pd.Series(np.full(len(texts), PRIOR))
        weight, bias = Weights(), sent.value[None]
        return pd.Series(sigmoid(np.array([
            bias + (sum(map(weight.__getitem__, sorted(distinct_words(t)))) if t else 0.0) for t in texts])), dtype="float64")

    return docs.withColumn(into, score(F.col("text").cast("string")))
