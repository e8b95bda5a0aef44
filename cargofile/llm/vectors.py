"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, reranking with the original vectors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargofile.llm.common import components, dealt, few, hot_join, id_ties, spread, stars, stored

COSINE = 0.93
SAMPLE = 10_000
MISS = 0.005
TASK_ROWS = 1_024


def rotation(rows: np.ndarray, size: int, seed: int, rounds: int = 30) -> np.ndarray:
    """An orthogonal rotation that brings unit rows close to the corners of the cube, from a random start."""
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))[0]
    for _ in range(rounds if len(rows) >= size else 0):
        left, _, right = np.linalg.svd(np.where(rows @ turn >= 0, 1.0, -1.0).T @ rows)
        turn = (left @ right).T
    return turn


def tables_for(most: int, cosine: float, miss: float) -> tuple[int, int]:
    """Bits of a table's key and the number of tables: keys grow with the logarithm of the largest label, and the tables
    are as many as leave a pair at the threshold without a common key with at most the probability `miss`."""
    bits = min(48, max(8, math.ceil(math.log2(max(2, most))) + 1))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, miss: float = MISS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors (vec_id, embedding, label).

    Vectors with equal label and equal components are one class, which is coded once. Rotations are learned from at most
    `sample` classes (by hash order) of the commonest dimension; every class is indexed. Classes with an equal key in a
    table meet in tasks of bounded size (see dealt), are compared by cosine in double precision, and a pair counts in the
    first table that joins it only, so counts and component edges leave a task, no pair list.

    A vector that is null, empty, zero or holds a null or non-finite component, or that has no label, links with nothing:
    0 links, its own component. Vectors of other dimensions never link with each other. Rows that repeat a vec_id count
    as vectors of their own but share a component. A null vec_id is left out of links and keeps a null component.
    Other columns are ignored; an empty table gives no rows.
    """
    emb = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & emb.isNotNull() & F.forall(
        emb, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(emb, lambda x: x != 0)
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), emb.alias("emb"),
        F.coalesce(sound, F.lit(False)).alias("sound"), F.xxhash64("label", "embedding").alias("k1"),
        F.xxhash64(F.lit(1), "label", "embedding").alias("k2"))
    key = ["k1", "k2"]
    classes = stored(few(rows.where("sound").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))), "classes")
    one = rows.where("sound").join(classes.withColumnRenamed("rep", "vec_id"), [*key, "vec_id"]).dropDuplicates(key).select(
        F.col("vec_id").alias("rep"), "label", F.size("emb").alias("size"), "emb", "copies", *key)
    one = stored(few(one), "vectors")
    most = one.groupBy("label", "size").count().agg(F.max("count")).first()[0] or 0
    common = one.groupBy("size").count().orderBy(F.desc("count"), "size").limit(1).collect()
    bits, tables = tables_for(most, cosine, miss)
    turns = []
    if common:
        size = common[0]["size"]
        some = one.where(F.col("size") == size).orderBy(F.xxhash64("k1"), "k1", "k2").limit(sample).select("emb").collect()
        learned = _units(np.array([r["emb"] for r in some], float))
        turns = [rotation(learned, size, seed) for seed in range(math.ceil(bits * tables / size))]

    def coded(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for size, part in batch.groupby("size", sort=False):
                unit = _units(np.stack(part["emb"].to_list()))
                own = turns if turns and len(turns[0]) == size else [
                    rotation(unit[:0], size, seed) for seed in range(math.ceil(bits * tables / size))]
                signs = np.concatenate([unit @ t >= 0 for t in own], axis=1)[:, :bits * tables]
                codes = signs.reshape(len(part), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
                out.append(part.assign(codes=list(codes)))
            if out:
                yield pd.concat(out)

    full = stored(one.mapInPandas(coded, "rep long, label string, size int, emb array<double>, copies long, k1 long, "
                                         "k2 long, codes array<long>"), "codes")
    keys = full.select("k1", "k2", F.posexplode("codes").alias("pos", "code"), "label", "size").withColumn(
        "grp", F.xxhash64("label", "size", "pos", "code")).select("k1", "k2", "pos", "grp")
    busy = keys.groupBy("grp").agg(F.count("*").alias("rows")).where("rows > 1")
    members = hot_join(keys, busy, ["grp"], "rows").join(full, key)
    tasks = dealt(members, ["grp"], F.col("k1"), F.lit(1), TASK_ROWS)

    def compared(pdf):
        import pandas as pd

        out = []
        for _, group in pdf.groupby(["grp", "size"], sort=False):
            unit, ids, copies = _units(np.stack(group["emb"].to_list())), group["rep"].to_numpy(), group["copies"].to_numpy()
            codes, pos, side = np.stack(group["codes"].to_list()), group["pos"].to_numpy(), group["side"].to_numpy()
            label = group["label"].to_numpy()
            close = np.triu(unit @ unit.T >= cosine, 1)
            if (side >= 0).any():
                close &= side[:, None] != side[None, :]
            i, j = np.nonzero(close)
            first = np.concatenate([np.argmax(codes[i[k:k + 65536]] == codes[j[k:k + 65536]], axis=1)
                                    for k in range(0, len(i), 65536)] or [np.zeros(0, np.int64)])
            good = (label[i] == label[j]) & (pos[i] == pos[j]) & (first == pos[i])
            i, j = i[good], j[good]
            counts = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
            key1, key2 = group["k1"].to_numpy(), group["k2"].to_numpy()
            at = np.nonzero(counts)[0]
            linked = np.zeros((len(ids), len(ids)), bool)
            linked[i, j] = linked[j, i] = True
            low = dict(stars(ids[at], linked[np.ix_(at, at)])) if len(at) else {}
            out += [(int(key1[k]), int(key2[k]), int(counts[k]), int(ids[k]), int(low.get(int(ids[k]), ids[k]))) for k in at]
        return pd.DataFrame(out, columns=["k1", "k2", "n", "a", "b"], dtype="int64")

    links = stored(spread(tasks.groupBy("task").applyInPandas(compared, "k1 long, k2 long, n long, a long, b long")), "links")
    ties = id_ties(rows.where("sound").select(F.col("vec_id").alias("id"), *key), classes)
    final = components(links.select("a", "b").union(ties))
    per = classes.join(links.groupBy(*key).agg(F.sum("n").alias("n")), key, "left").join(
        final, F.col("rep") == F.col("node"), "left").select(
            *key, "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component"))
    sound_rows = hot_join(rows.where("sound").select("vec_id", *key), per, key, "copies", "left")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    return sound_rows.select("vec_id", "n_links", "component").union(alone).select(
        "vec_id", "n_links", F.col("component").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"))


def _units(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
