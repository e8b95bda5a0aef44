"""Document quality by co-training: a text view and a metadata view teach each other with confident pseudo-labels."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargofile.llm.common import BROADCAST_ROWS, alphanumeric_table, few, stored

TABLE = alphanumeric_table()
SYMBOLS = re.compile(r"[^\w\s.,;:!?'\"()-]")
BINS = 16
WORD_SLOTS = 1 << 15
META_SLOTS = 4_096
FOLDS = 4
ROUNDS = 3
SURE = 0.97
PSEUDO_WEIGHT = 0.5
SMOOTH = 1.0
# The size of a text belongs to the metadata view alone; the measures here are shares and means.
MEASURES = ("word_length", "distinct_words", "symbols", "digits", "capitals", "line_length", "distinct_lines",
            "ends_with_stop", "stops", "longest_word", "bars", "commonest_word")
META = ("source", "lang", "n_chars")
# Slots that stand for themselves; those after them (words) count by their mean.
SINGLE = {"text": len(MEASURES), "meta": 4}
SIZES = {"text": len(MEASURES) * BINS + WORD_SLOTS, "meta": 4 * META_SLOTS}


def measured(text: str) -> tuple[list[float], list[int]]:
    """The values of MEASURES for a whole text, and the distinct slots of its words."""
    lines, own = text.split("\n"), text.encode("utf-8", "surrogatepass").translate(TABLE).split()
    chars, count = max(1, len(text)), max(1, len(own))
    kinds = Counter(own)
    letters = sum(map(len, own))
    values = [letters / count, len(kinds) / count, len(SYMBOLS.findall(text)) / chars,
              sum(map(text.count, "0123456789")) / chars, sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / chars,
              len(text) / len(lines), len(set(lines)) / len(lines),
              sum(x.rstrip().endswith((".", "!", "?")) for x in lines) / len(lines), text.count(".") / count,
              float(max(map(len, own), default=0)), text.count("|") / count, max(kinds.values(), default=0) / count]
    first = len(MEASURES) * BINS
    return values, sorted({first + zlib.crc32(w) % WORD_SLOTS for w in kinds})


def meta_slots() -> Column:
    """Slots of source, language, source with language, and the binary logarithm of the stated size."""
    size = F.floor(F.log2(F.greatest(F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)), F.lit(0.0)) + 1)).cast("string")
    parts = [F.col("source"), F.col("lang"), F.concat_ws("/", "source", "lang"), size]
    return F.array(*[(F.pmod(F.xxhash64(F.lit(k), F.coalesce(p, F.lit(""))), F.lit(META_SLOTS)) + k * META_SLOTS).cast("int")
                     for k, p in enumerate(parts)])


def features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the slots of both views (text, meta), y: the label or null, and fold: of rows with a label, else FOLDS.

    What is costly to make is stored; bins are cut from it as it is read.
    """

    @F.pandas_udf("m array<double>, words array<int>")
    def measures(texts):
        import pandas as pd

        return pd.DataFrame([measured(t) for t in texts], columns=["m", "words"])

    known = stored(few(labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_id")).agg(
        F.min("quality").cast("double").alias("y"))), "labels")
    # Few labels come to the documents; more are joined by shuffle.
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    own = [(F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c) for c in META]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *own).select(
        "doc_id", meta_slots().alias("meta"), measures(F.coalesce("text", F.lit(""))).alias("t"))
    rows = stored(rows.join(known, F.col("doc_id") == F.col("_id"), "left").select(
        "doc_id", "meta", "t.m", "t.words", "y"), "measures")
    steps = [k / BINS for k in range(1, BINS)]
    cuts = rows.agg(*[F.percentile_approx(F.col("m")[k], steps, 1000).alias(f"c{k}") for k in range(len(MEASURES))]).first()
    slots = []
    for k in range(len(MEASURES)):
        nr = F.lit(k * BINS)
        for edge in sorted(set(cuts[k] or [])):
            nr = nr + (F.col("m")[k] > edge).cast("int")
        slots.append(nr)
    fold = F.when(F.col("y").isNull(), FOLDS).otherwise(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(FOLDS))).cast("int")
    return rows.select("doc_id", "meta", F.concat(F.array(*slots), "words").alias("text"), "y", fold.alias("fold"))


def trained(rows: DataFrame, view: str, target: Column, weight: Column) -> np.ndarray:
    """Naive Bayes log-odds of each slot of a view, the prior last: one row for each fold left out, then one of all rows.

    Smoothing follows the classes' shares, so a slot that no row with a target has says nothing.
    """
    size = SIZES[view]
    good, bad = F.sum(F.col("_w") * F.col("_y")).alias("good"), F.sum(F.col("_w") * (1 - F.col("_y"))).alias("bad")
    base = rows.select(view, "fold", target.alias("_y"), weight.alias("_w")).where("_y is not null")
    # At most size * (FOLDS + 1) and FOLDS + 1 rows come back.
    sums = base.select(F.explode(view).alias("slot"), "fold", "_y", "_w").groupBy("slot", "fold").agg(good, bad).toPandas()
    totals = base.groupBy("fold").agg(good, bad).toPandas()
    counts = np.zeros((2, FOLDS + 1, size + 1))
    for part, at in ((sums, sums["slot"].to_numpy(int)), (totals, np.full(len(totals), size))):
        for side, name in enumerate(("good", "bad")):
            counts[side, part["fold"].to_numpy(int), at] = part[name].to_numpy(float)
    every = counts.sum(axis=1)
    left = every[:, None, :] - counts
    left[:, FOLDS] = every
    g, b = left[0, :, -1:] + SMOOTH, left[1, :, -1:] + SMOOTH
    share = g / (g + b)
    odds = np.log((left[0] + SMOOTH * share) / g) - np.log((left[1] + SMOOTH * (1 - share)) / b)
    odds[:, -1:] = np.log(g / b)
    return odds.astype(np.float32)


def raw_score(weights: np.ndarray, view: str) -> Column:
    """Log-odds by a view, of rows with a label by the classifier that has not seen their fold."""
    single = SINGLE[view]

    @F.pandas_udf("double")
    def score(slots, folds):
        import pandas as pd

        out = []
        for own, fold in zip(slots, folds):
            odds = weights[fold, own]
            out.append(float(odds[:single].sum() + weights[fold, -1] + (odds[single:].mean() * single if len(own) > single else 0)))
        return pd.Series(out, dtype="float64")

    return score(F.col(view), F.col("fold"))


def calibration(rows: DataFrame, score: str) -> tuple[np.ndarray, np.ndarray]:
    """Raw scores and calibrated probabilities: shares of good labels by rounded score, pooled until they rise."""
    sums = rows.where("y is not null").groupBy(F.round(F.least(F.greatest(F.col(score), F.lit(-60.0)), F.lit(60.0)) * 2).alias("s")).agg(
        F.sum("y").alias("good"), F.count("*").alias("n")).orderBy("s").toPandas()
    share = sums["good"].sum() / max(1, sums["n"].sum()) if len(sums) else 0.5
    blocks = []
    for s, good, n in sums.itertuples(index=False):
        blocks.append([[s / 2], float(good), float(n)])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    x = np.array([v for at, _, _ in blocks for v in at] or [0.0])
    # Small blocks lean to the share of all rows; the running maximum keeps the curve rising.
    p = np.maximum.accumulate(np.array([(g + share) / (n + 1) for at, g, n in blocks for _ in at] or [share]))
    return x, np.clip(p, 1e-4, 1 - 1e-4)


def calibrated(curve: tuple[np.ndarray, np.ndarray], score: str) -> Column:
    @F.pandas_udf("double")
    def probability(values):
        import pandas as pd

        return pd.Series(np.interp(values.to_numpy(), *curve), dtype="float64")

    return probability(F.col(score))


def quality_scores(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, sure: float = SURE) -> DataFrame:
    """(doc_id, text_score, meta_score, score, predicted, kept): one row per row of docs.

    The text view sees the hashed words of the whole text and binned measures of it, none of them its
    size; the metadata view sees source, language and stated size. Each is a naive Bayes classifier whose counts are
    summed over all rows. Rows with a label are scored by a classifier that has not seen their fold, and these scores
    calibrate the view. In each round, a view labels the rows without label of which its calibrated probability is at
    least `sure` (or at most 1 - sure) for the other view, which counts them with PSEUDO_WEIGHT. At the end the
    calibrated log-odds of both views are added and the prior's taken off once.

    Null texts and metadata count as empty, metadata columns that docs lack as null; of a repeated doc_id the lowest
    label counts; rows without doc_id have no label but a score; without any label every score is 0.5; other columns are
    ignored; an empty table gives no rows.
    """
    rows = features(docs, labels)
    base, taught = rows, {"text": F.lit(None).cast("double"), "meta": F.lit(None).cast("double")}
    for _ in range(rounds + 1):
        seen = rows
        for view in ("text", "meta"):
            weights = trained(base, view, F.coalesce("y", taught[view]),
                              F.when(F.col("y").isNotNull(), 1.0).otherwise(PSEUDO_WEIGHT))
            seen = seen.withColumn(f"raw_{view}", raw_score(weights, view))
        for view in ("text", "meta"):
            seen = seen.withColumn(f"p_{view}", calibrated(calibration(seen, f"raw_{view}"), f"raw_{view}"))
        base = seen
        for view, other in (("text", "meta"), ("meta", "text")):
            p = F.col(f"p_{view}")
            taught[other] = F.when(p >= sure, 1.0).when(p <= 1 - sure, 0.0)
    prior = rows.where("y is not null").agg(F.avg("y")).first()[0]
    prior = min(max(prior, 1e-4), 1 - 1e-4) if prior is not None else 0.5

    def odds(c: str) -> Column:
        return F.log(F.col(c) / (1 - F.col(c)))

    joint = odds("p_text") + odds("p_meta") - F.lit(float(np.log(prior / (1 - prior))))
    return seen.select("doc_id", F.col("p_text").alias("text_score"), F.col("p_meta").alias("meta_score"),
                       (1 / (1 + F.exp(-joint))).alias("score")).withColumn(
                           "predicted", (F.col("score") >= 0.5).cast("int")).withColumn("kept", F.col("score") >= 0.5)
