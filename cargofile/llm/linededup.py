"""Reversible line deduplication: sharded cuckoo filters in front of exact reference counts of lines."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cargofile.llm.common import completed, few, fresh, hot_join, last_complete, mixed, spread, stored

LEAST_CHARS = 10
# Line keys for which a shard is made, and line keys that a task tests against a shard's filter at once.
SHARD_KEYS, TESTED_KEYS = 50_000, 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Cuckoo:
    """A cuckoo filter over 64-bit hashes: buckets of four 16-bit fingerprints, each hash in one of two buckets."""

    SLOTS, ROUNDS = 4, 400

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        return cls(np.zeros((1 << max(3, math.ceil(math.log2(max(1, keys) / cls.SLOTS / 0.85))), cls.SLOTS), np.uint16))

    @classmethod
    def built(cls, hashes: np.ndarray) -> Cuckoo:
        """A filter that holds all hashes; doubled until they fit."""
        own = cls.sized(len(hashes))
        while not own.insert(hashes):
            own = cls(np.zeros((2 * len(own.table), cls.SLOTS), np.uint16))
        return own

    def _places(self, hashes: np.ndarray):
        mixed_ = mixed(hashes.astype(np.uint64))
        mark = ((mixed_ >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = (mixed_ & np.uint64(len(self.table) - 1)).astype(np.int64)
        return first, self._other(first, mark), mark

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mixed(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _put(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Puts marks where their bucket has room; which of them are left over."""
        order = np.argsort(bucket, kind="stable")
        sorted_ = bucket[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_, sorted_)
        free = self.table[sorted_] == 0
        fits = rank < free.sum(axis=1)
        slot = np.argsort(~free, axis=1, kind="stable")[np.arange(len(order)), np.minimum(rank, self.SLOTS - 1)]
        self.table[sorted_[fits], slot[fits]] = mark[order][fits]
        left = np.zeros(len(order), bool)
        left[order[~fits]] = True
        return left

    def insert(self, hashes: np.ndarray) -> bool:
        """Adds every hash, moving marks to their other bucket in rounds; False if some found no room."""
        bucket, other, mark = self._places(hashes)
        pick = np.random.default_rng(len(hashes))
        for _ in range(self.ROUNDS):
            left = self._put(bucket, mark)
            bucket, other, mark = other[left], bucket[left], mark[left]
            if not len(mark):
                return True
            left = self._put(bucket, mark)
            bucket, mark = bucket[left], mark[left]
            if not len(mark):
                return True
            at, who = np.unique(bucket, return_index=True)
            slot = pick.integers(0, self.SLOTS, len(at))
            out = self.table[at, slot]
            self.table[at, slot] = mark[who]
            mark[who] = out
            bucket[who] = self._other(at, out)
            other = self._other(bucket, mark)
        return False

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        first, other, mark = self._places(hashes)
        return ((self.table[first] == mark[:, None]) | (self.table[other] == mark[:, None])).any(axis=1)

    def delete(self, hashes: np.ndarray) -> None:
        """Takes out one mark of each hash; only hashes that were inserted may be given."""
        for first, other, mark in zip(*self._places(hashes)):
            for bucket in (first, other):
                slot = np.nonzero(self.table[bucket] == mark)[0]
                if len(slot):
                    self.table[bucket, slot[0]] = 0
                    break


def line_keys(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, version, pos, h1, h2) of the lines long enough to count; version tells texts of one doc_id apart."""
    line = F.translate(F.btrim("line", F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)
    # The version is taken before the text is cut, so no line carries its text.
    docs = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
    lines = docs.select("doc_id", "version", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.withColumn("line", line).where(F.length("line") >= least).select(
        "doc_id", "version", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def stored_keys(docs: DataFrame) -> DataFrame:
    """line_keys of docs, written once: about 40 bytes a line stand for the text wherever its lines are looked at again."""
    return stored(line_keys(plain(docs)), "line-keys")


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


class LineIndex:
    """The lines of a growing and shrinking corpus, in a shared folder.

    log: one row per (line key, document) reference, +1 when a document comes and -1 when it goes. counts: what the log
    sums to, exact: how many documents hold the key and the smallest of them. filters: per shard of keys a cuckoo filter
    of the keys that two documents or more hold, updated by what an insertion or deletion changed. When all keys outgrow
    the shards these are cut anew, twice as many at least, and all filters are built from the counts. Line keys are met
    with the filter of their shard in the shard's tasks, however many there are; no filter is sent anywhere else. Every version is a
    new folder that is used only once it is complete: its number and shards are then added to the manifest `complete`,
    from which every index opened on the folder goes on. A lost job can be run again. One job at a time may change a folder.
    Keys are 128-bit hashes. A document counts once however often it holds a line or is given.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, shard_keys: int = SHARD_KEYS):
        self.spark, self.root = spark, root or fresh(spark, "lines")
        self.shard_keys = shard_keys
        self._open()

    def _open(self) -> None:
        self.version, shards = last_complete(self.spark, self.root, ["version", "shards"])
        self.shards = max(1, shards)

    def _path(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/{version:06d}"

    def counts(self, version: int | None = None) -> DataFrame:
        """(h1, h2, refs, owner): keys that at least two documents hold, and the smallest doc_id that does."""
        version = self.version if version is None else version
        if not version:
            return self.spark.createDataFrame([], "h1 long, h2 long, refs long, owner long")
        return self.spark.read.parquet(self._path("counts", version))

    def filters(self) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], "shard long, data binary")
        return self.spark.read.parquet(self._path("filters", self.version))

    def log(self, version: int | None = None) -> DataFrame:
        version = self.version if version is None else version
        return self.spark.read.parquet(*[self._path("log", v) for v in range(1, version + 1)])

    def insert(self, docs: DataFrame, lines: DataFrame | None = None) -> None:
        """Adds documents (doc_id, text). Rows without doc_id hold no reference; given again, a document adds nothing.

        lines: stored_keys(docs), where the caller has them.
        """
        self._open()
        lines = line_keys(plain(docs)) if lines is None else lines
        new = lines.where("doc_id is not null").select("h1", "h2", "doc_id").distinct()
        if self.version:
            new = new.join(self._live(self.log()), ["h1", "h2", "doc_id"], "left_anti")
        self._step(new.withColumn("sign", F.lit(1)))

    def delete(self, ids: DataFrame) -> None:
        """Removes documents by doc_id; lines that only they shared are unique again, and owners move on."""
        self._open()
        if self.version:
            gone = self._live(self.log()).join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
            self._step(gone.select("h1", "h2", "doc_id", F.lit(-1).alias("sign")))

    @staticmethod
    def _live(log: DataFrame) -> DataFrame:
        return log.groupBy("h1", "h2", "doc_id").agg(F.sum("sign").alias("n")).where("n > 0").drop("n")

    def _step(self, change: DataFrame) -> None:
        old = self.counts()
        next_ = self.version + 1
        few(change).write.mode("overwrite").parquet(self._path("log", next_))
        log = self.log(next_)
        live = log.drop("sign") if next_ == 1 else self._live(log)
        held = Observation()
        counts = live.groupBy("h1", "h2").agg(F.count("*").alias("refs"), F.min("doc_id").alias("owner"))
        counts = counts.observe(held, F.count("*").alias("keys")).where("refs > 1")
        few(counts).write.mode("overwrite").parquet(self._path("counts", next_))
        new = self.counts(next_)
        needed, shards = max(1, math.ceil(held.get["keys"] / self.shard_keys)), self.shards
        if not self.version:
            shards = needed
        elif needed > shards:
            shards = max(needed, 2 * shards)
        shard = F.pmod(F.col("h1"), F.lit(shards)).alias("shard")
        if not self.version or shards != self.shards:
            filters = new.select(shard, "h1").groupBy("shard").applyInPandas(_built, "shard long, data binary")
        else:
            filters = self._changed(old, new, shard, next_)
        few(filters).write.mode("overwrite").parquet(self._path("filters", next_))
        completed(self.spark, self.root, {"version": next_, "shards": shards})
        self.version, self.shards = next_, shards

    def _changed(self, old: DataFrame, new: DataFrame, shard: Column, next_: int) -> DataFrame:
        """The filters after what turned from old to new counts; those that it doesn't fit are built from new."""
        keys = ["h1", "h2"]
        turned = new.join(old, keys, "left_anti").select(shard, "h1", F.lit(1).alias("sign")).union(
            old.join(new, keys, "left_anti").select(shard, "h1", F.lit(-1).alias("sign")))
        tried = self.filters().groupBy("shard").cogroup(turned.groupBy("shard")).applyInPandas(
            _updated, "shard long, data binary")
        path = self._path("tried", next_)
        few(tried).write.mode("overwrite").parquet(path)
        tried = self.spark.read.parquet(path)
        full = tried.where("data is null").select("shard")
        rebuilt = new.select(shard, "h1").join(full, "shard", "left_semi").groupBy("shard").applyInPandas(
            _built, "shard long, data binary")
        return tried.where("data is not null").union(rebuilt)

    def known(self, keys: DataFrame) -> DataFrame:
        """The keys (h1, h2), distinct and stored, that pass the filter of their shard: all shared ones and few others.

        Every shard's keys meet its filter in tasks of about TESTED_KEYS; a shard with more keys than that takes several.
        """
        parts = max(1, math.ceil(keys.count() / (self.shards * TESTED_KEYS)))
        shard = F.pmod(F.col("h1"), F.lit(self.shards))
        own = keys.select(shard.alias("shard"), F.pmod("h2", F.lit(parts)).alias("part"), "h1", "h2")
        filters = self.filters().withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        return own.groupBy("shard", "part").cogroup(filters.groupBy("shard", "part")).applyInPandas(_passing, "h1 long, h2 long")

    def shared_lines(self, lines: DataFrame) -> DataFrame:
        """lines (stored line_keys) with refs and owner, for those whose key two documents or more hold."""
        keys = stored(spread(lines.select("h1", "h2").distinct()), "line-distinct")
        table = self.counts().join(self.known(keys), ["h1", "h2"], "left_semi").withColumn("often", F.col("refs"))
        return hot_join(lines, stored(few(table), "line-shared"), ["h1", "h2"], "often")

    def cleaned(self, docs: DataFrame, lines: DataFrame | None = None) -> DataFrame:
        """docs with n_lines, n_dropped and kept: the text without lines that a document of smaller id holds.

        Splits at \\n; a null or empty text is one empty line. Lines whose key (white space stripped at both ends, A-Z
        lower-cased) has fewer than ten code points always stay, as do all lines of the key's smallest doc_id, repeats
        included. Rows that repeat a doc_id are one document. A row without doc_id drops every line that indexed
        documents share. Other columns pass through, whatever their names; those named like a result are replaced.
        lines: stored_keys(docs), where the caller has them.
        """
        self._open()
        names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept")]
        id_, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
        keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.xxhash64(text).alias("v"),
                            F.isnull(id_).alias("none"), F.coalesce(id_, F.xxhash64(text)).alias("k"))
        shared = self.shared_lines(stored_keys(docs) if lines is None else lines)
        drops = shared.where("doc_id is null or owner != doc_id").groupBy("doc_id", "version").agg(
            F.collect_set("pos").alias("drop"))
        drops = drops.select(F.coalesce("doc_id", "version").alias("k"), F.isnull("doc_id").alias("none"),
                             F.col("version").alias("v"), "drop")

        @F.pandas_udf("kept string, n_lines long, n_dropped long")
        def rest(text, drop):
            import pandas as pd

            rows = []
            for t, d in zip(text, drop):
                lines = t.split("\n")
                gone = set() if d is None else set(d.tolist())
                stay = [x for k, x in enumerate(lines) if k not in gone] if gone else lines
                rows.append((t if not gone else "\n".join(stay), len(lines), len(gone)))
            return pd.DataFrame(rows, columns=["kept", "n_lines", "n_dropped"])

        whole = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
        out = keyed.join(drops.hint("shuffle_hash"), ["k", "none", "v"], "left").withColumn("r", rest(whole, "drop"))
        return out.select(*[F.col("row")[c].alias(c) for c in names], "r.n_lines", "r.n_dropped", "r.kept")


def _loaded(data: bytes) -> Cuckoo:
    return Cuckoo(np.frombuffer(data, np.uint16).reshape(-1, Cuckoo.SLOTS))


def _passing(keys, filters):
    """The keys that a shard's filter holds; none where it has no filter."""
    if not len(filters):
        return keys[["h1", "h2"]].iloc[:0]
    return keys.loc[_loaded(bytes(filters["data"].iloc[0])).contains(keys["h1"].to_numpy()), ["h1", "h2"]]


def _updated(old, change):
    """A shard's filter after its changes; null data if the new keys don't fit."""
    import pandas as pd

    shard = int((old if len(old) else change)["shard"].iloc[0])
    come, go = (change.loc[change["sign"] == s, "h1"].to_numpy() if len(change) else np.zeros(0, np.int64) for s in (1, -1))
    if not len(old):
        data = Cuckoo.built(come).table.tobytes()
    else:
        own = Cuckoo(_loaded(bytes(old["data"].iloc[0])).table.copy())
        own.delete(go)
        data = own.table.tobytes() if own.insert(come) else None
    return pd.DataFrame({"shard": [shard], "data": [data]})


def _built(rows):
    import pandas as pd

    return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "data": [Cuckoo.built(rows["h1"].to_numpy()).table.tobytes()]})


def dedup_lines(docs: DataFrame) -> DataFrame:
    """LineIndex.cleaned of one batch that is indexed first; see there for edge cases. An empty table gives no rows."""
    index, lines = LineIndex(docs.sparkSession), stored_keys(docs)
    index.insert(docs, lines)
    return index.cleaned(docs, lines)
