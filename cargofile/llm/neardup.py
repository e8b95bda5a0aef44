"""Near-duplicate documents: fast similarity sketches, banding, then exact verification on full shingle sets."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargofile.llm.common import BROADCAST_ROWS, WordHashes, components, dealt, hot_join, id_ties, mixed, runs, slices, stars, stored

SHINGLE = 5
PERCENT = 80
BANDS = 40
BAND_ROWS = 6
# A task of the verification holds about this many shingles; every document counts OVERHEAD more, which bounds rows.
TASK_SHINGLES = 300_000
OVERHEAD = 200


def shingles(text: str, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; A-Z lower-cased, words cut at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.unique(runs(hashes.of(words), size))


def sketch(items: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketch of a non-empty set: each bin's smallest (round, hash) over rounds of hashed placement.

    Rounds 0 to bins-1 place every item in a hashed bin. Rounds from bins on place every item in bin round-bins, so every
    bin fills. Two sets agree in a bin with their Jaccard similarity as probability. Rounds after the one that fills the
    last bin change nothing, so several are computed at a time.
    """
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out, low = np.full(bins, full, np.uint64), np.uint64(0xFFFFFFFF)
    step, first = max(1, 1024 // len(items)), 0
    while first < bins and (out == full).any():
        rounds = np.arange(first, min(bins, first + step), dtype=np.uint64)
        hashed = mixed(items[None, :] ^ mixed(rounds + np.uint64(1))[:, None])
        at = ((hashed >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        value = (rounds[:, None] << np.uint64(48)) | (hashed & low)
        np.minimum.at(out, at.ravel().astype(np.int64), value.ravel())
        first += step
    for k in np.nonzero(out == full)[0]:
        number = np.array([bins + k], np.uint64)
        hashed = mixed(items ^ mixed(number + np.uint64(1)))
        out[k] = ((number << np.uint64(48)) | (hashed & low).min())[0]
    return out


def band_hashes(values: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band of a sketch."""
    rows = values.reshape(bands, -1)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows.shape[1]):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return out


def sketches(docs: DataFrame, size: int, bands: int, band_rows: int) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, bands): set size, 128-bit key of the set and band keys; none for an empty set."""

    def rows(batches):
        import pyarrow as pa

        hashes = WordHashes()
        for batch in slices(batches):
            counts, keys, found = [], [], []
            for text in batch.column("text").to_pylist():
                own = shingles(text, size, hashes)
                counts.append(len(own))
                keys.append(np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64) if len(own) else np.zeros(2, np.int64))
                found.append(band_hashes(sketch(own, bands * band_rows), bands).view(np.int64) if len(own) else [])
            k1, k2 = np.array(keys, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(k1), pa.array(k2),
                 pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "k1", "k2", "bands"])

    return docs.mapInArrow(rows, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def sets(docs: DataFrame, size: int) -> DataFrame:
    """docs (doc_id, text, grp) as (doc_id, grp, n, items): the full shingle sets, for candidates only."""

    def rows(batches):
        import pyarrow as pa

        hashes = WordHashes()
        for batch in slices(batches):
            own = [shingles(t, size, hashes).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("grp"), pa.array([len(x) for x in own], pa.int64()),
                 pa.array(own, pa.list_(pa.int64()))], names=["doc_id", "grp", "n", "items"])

    return docs.select("doc_id", "text", "grp").mapInArrow(rows, "doc_id long, grp long, n long, items array<long>")


def overlaps(items: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections within one bounded block: products of 0/1 columns of the shingles that two sets share."""
    count = len(items)
    if count <= 12:
        out = np.zeros((count, count), np.int64)
        for i in range(count):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(items[i], items[j], assume_unique=True))
        return out
    owner = np.repeat(np.arange(count), [len(x) for x in items])
    _, column, often = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    owner, column = owner[shared], (np.cumsum(often > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((count, count), np.float64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, [first, first + 4096])
        block = np.zeros((count, 4096), np.float32)
        block[owner[lo:hi], column[lo:hi] - first] = 1
        block = block[:, block.any(axis=0)]
        out += block @ block.T
    return out.astype(np.int64)


def verified(members: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect exactly the documents of each task's group whose full sets are similar enough."""

    def links(pdf):
        import pandas as pd

        out = []
        for _, group in pdf.groupby("grp", sort=False):
            items, ids = list(group["items"]), group["doc_id"].to_numpy()
            side, sizes = group["side"].to_numpy(), group["n"].to_numpy()
            shared = overlaps(items)
            linked = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
            linked |= ids[:, None] == ids[None, :]
            if (side >= 0).any():
                linked &= side[:, None] != side[None, :]
            out += stars(ids, linked)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return members.groupBy("task").applyInPandas(links, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS,
                    band_rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of docs, components of the exact similarity links.

    Documents with equal sets form one class, known by its smallest doc_id. Classes that share a band key with the
    smallest class of its bucket become candidates of one group; each group is verified on full sets in tasks of bounded
    weight (see dealt), so every two candidates of a group are compared and no pair list is written. A pair at the
    threshold of 80 per cent is missed by banding with a probability of (1 - 0.8^6)^40, 5 in a million; at 85 per cent 6
    in a thousand million.

    Null or empty texts have no shingle and link with nothing. Rows that repeat a doc_id are one node: what links with
    either has their component. Rows without doc_id link with nothing and are kept; their component is null. Other
    columns are ignored; an empty table gives no rows.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = stored(sketches(text, size, bands, band_rows), "sketches")
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    one = rows.join(classes.select("k1", "k2", F.col("rep").alias("doc_id")), ["k1", "k2", "doc_id"], "left_semi")
    keys = one.select("doc_id", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last"),
                                    F.count("*").alias("rows")).where("hub < last")
    near = hot_join(keys, hubs, ["key"], "rows").where("doc_id != hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    groups = components(near).select(F.col("node").alias("doc_id"), F.col("component").alias("grp"))
    few = groups.count() <= BROADCAST_ROWS
    chosen = text.join(F.broadcast(groups) if few else groups, "doc_id")
    members = stored(sets(chosen, size), "sets")
    links = verified(dealt(members, ["grp"], F.col("doc_id"), F.col("n") + OVERHEAD, TASK_SHINGLES), percent)
    # Rows that repeat an id tie their classes together.
    ties = id_ties(rows.where("n_shingles > 0 and doc_id is not null").select(
        F.col("doc_id").alias("id"), "k1", "k2"), classes)
    final = components(links.union(ties))
    of_class = classes.join(final, F.col("rep") == F.col("node"), "left").select(
        "k1", "k2", "rep", F.coalesce("component", "rep").alias("component_id"), "copies")
    alone = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    of_class = of_class.where("copies > 1 or component_id != rep").drop("rep")
    return hot_join(rows.select("doc_id", "n_shingles", "k1", "k2"), of_class, ["k1", "k2"], "copies", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), alone).alias("component_id")).withColumn(
            "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
