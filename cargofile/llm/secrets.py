"""Secret scans over content-addressed texts: each text is scanned once per rule version, wherever it occurs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cargofile.llm.common import completed, few, fresh, hot_join, last_complete, spread, unused


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match is dropped if its group `group` has fewer than `least` code points."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# Patterns and shortest lengths of the kinds.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # A run of at least 16 is the same as a longest run with that length; short runs need no row of their own.
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("repo_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + MORE


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def matches(texts: DataFrame, rules: tuple[Rule, ...], todo: Column | None = None) -> DataFrame:
    """(blob, kind, start, stop) of each rule's leftmost non-overlapping matches in texts (blob, text).

    The pieces between matches and the matches take turns, so a match starts after the lengths of all before it; offsets
    are running sums over the matches of one text, in code points, stop exclusive. todo: rule keys to scan a row for.
    """
    found = []
    for rule in rules:
        hits = F.struct(
            F.lit(rule.kind).alias("kind"), F.lit(rule.pattern).alias("pattern"),
            F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)).alias("hits"),
            F.transform(F.split("text", rule.pattern), F.length).alias("gaps"))
        wanted = F.col("text").rlike(rule.pattern)
        found.append(F.when(wanted if todo is None else F.array_contains(todo, rule.key) & wanted, hits))
    kinds = texts.select("blob", F.explode(F.array_compact(F.array(*found))).alias("f"))
    rows = kinds.select("blob", "f.kind", F.posexplode(F.arrays_zip(
        F.col("f.hits").alias("hit"), F.slice("f.gaps", 1, F.size("f.hits")).alias("gap"))).alias("pos", "m"))
    before = Window.partitionBy("blob", "kind").orderBy("pos")
    rows = rows.select("blob", "kind", "pos", F.col("m.hit").alias("hit"), F.col("m.gap").alias("gap")).withColumn(
        "stop", F.sum(F.col("gap") + F.length("hit")).over(before))
    short = F.lit(False)
    for rule in rules:
        if rule.least > 1:
            part = F.regexp_extract("hit", rule.pattern, rule.group) if rule.group else F.col("hit")
            short = short | ((F.col("kind") == rule.kind) & (F.length(part) < rule.least))
    return rows.where(~short).select("blob", "kind", (F.col("stop") - F.length("hit")).alias("start"), "stop")


class BlobLedger:
    """What has been scanned, and what was found, by content, in a shared folder.

    scans: (blob, rules), the rule versions a text was scanned for; findings: (blob, rule, kind, start, stop). Each update
    adds a batch to both and then its number to the manifest `complete`. Batches count from there on, for every ledger
    that is opened on the folder, with any rules; only a batch of a lost job, which the manifest lacks, is written over.
    A text that comes back, at any path and in any version of it, is not scanned again for a rule version it was
    scanned for. One job at a time may update a folder.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, rules: tuple[Rule, ...] = RULES):
        self.spark, self.root, self.rules, self.batches = spark, root or fresh(spark, "blobs"), rules, 0
        self._open()

    def _open(self) -> None:
        self.batches, = last_complete(self.spark, self.root, ["batch"])

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{name}/{k:06d}" for k in range(1, self.batches + 1)])

    def unseen(self, versions: DataFrame) -> DataFrame:
        """(blob, text, todo): one row per distinct text that lacks a scan, with the rule versions it lacks."""
        self._open()
        every = F.array(*[F.lit(r.key) for r in self.rules])
        texts = versions.select(blob_id(F.col("text")).alias("blob"),
                                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        if self.batches:
            done = self._read("scans").groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
            whole = done.where(F.size(F.array_except(every, "done")) == 0)
            texts = texts.join(whole, "blob", "left_anti").groupBy("blob").agg(F.first("text").alias("text"))
            return texts.join(done, "blob", "left").select(
                "blob", "text", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))).alias("todo"))
        return texts.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", every)

    def update(self, versions: DataFrame) -> None:
        """Scans what versions (path columns, text) bring that is new. A null text is an empty one."""
        new = self.unseen(versions)
        next_ = self.batches + 1
        found = matches(new, self.rules, F.col("todo"))
        keys = F.create_map(*[x for r in self.rules for x in (F.lit(r.kind), F.lit(r.key))])
        spread(found.select("blob", keys[F.col("kind")].alias("rule"), "kind", "start", "stop")).write.mode("overwrite").parquet(
            f"{self.root}/findings/{next_:06d}")
        scans = versions.select(blob_id(F.col("text")).alias("blob")).distinct()
        few(scans.withColumn("rules", F.array(*[F.lit(r.key) for r in self.rules]))).write.mode("overwrite").parquet(
            f"{self.root}/scans/{next_:06d}")
        completed(self.spark, self.root, {"batch": next_})
        self.batches = next_

    def findings(self) -> DataFrame:
        """Distinct (blob, kind, start, stop) by the current rule versions."""
        self._open()
        return self._read("findings").where(F.col("rule").isin([r.key for r in self.rules])).select(
            "blob", "kind", "start", "stop").distinct()

    def by_path(self, versions: DataFrame) -> DataFrame:
        """versions without text, with `found`: array of (start, nr, stop, kind) by start, then rule order; null if none.

        A text's matches are gathered in one array, which the text's length bounds. Texts at many paths are joined where
        the paths lie (hot_join), so copies do not meet in a task. A column of versions called `found` is replaced, all
        others pass through whatever their names.
        """
        order = F.create_map(*[x for k, r in enumerate(self.rules) for x in (F.lit(r.kind), F.lit(k))])
        blob, often = unused("_blob", versions), unused("_often", versions)
        paths = versions.withColumn(blob, blob_id(F.col("text"))).drop("text", "found")
        per = self.findings().groupBy(F.col("blob").alias(blob)).agg(F.sort_array(F.collect_list(
            F.struct("start", order[F.col("kind")].alias("nr"), "stop", "kind"))).alias("found"))
        times = paths.groupBy(blob).agg(F.count("*").alias(often))
        return hot_join(paths, per.join(times, blob), [blob], often, "left").drop(blob)


def spans_text(found: Column) -> Column:
    """kind:start:stop of each match, joined by commas."""
    one = F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string")))
    return F.coalesce(F.array_join(one, ","), F.lit(""))


def of_kind(found: Column, kinds: list[str]) -> Column:
    return F.coalesce(F.filter(found, lambda x: x["kind"].isin(kinds)), F.array().cast(
        "array<struct<start:bigint,nr:int,stop:bigint,kind:string>>"))
