"""Helpers that several operators share: stored stages, connected components, bounded tasks, hashed words."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows up to which a narrow table of ids may be broadcast (16 bytes a row in the task, about 50 MB as Spark holds it).
BROADCAST_ROWS = 500_000
ARROW_ROWS = 1_000


def folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; a folder of our own only where none is set, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        path = tempfile.mkdtemp(prefix="cargofile-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def last_complete(spark: SparkSession, root: str, columns: list[str]) -> tuple[int, ...]:
    """Values of the whole-number columns in the row of `root`'s manifest whose first is largest; zeros if it has none."""
    try:
        rows = spark.read.schema(", ".join(f"{c} long" for c in columns)).parquet(f"{root}/complete")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return (0,) * len(columns)
    return tuple(rows.orderBy(F.desc(columns[0])).first() or (0,) * len(columns))


def completed(spark: SparkSession, root: str, values: dict[str, int]) -> None:
    """Adds a row to `root`'s manifest: one file, so a reader sees all of it or nothing. Written when all else is."""
    spark.range(1).coalesce(1).select(*[F.lit(v).cast("long").alias(c) for c, v in values.items()]).write.mode(
        "append").parquet(f"{root}/complete")


def lean(spark: SparkSession) -> None:
    """Rows go to Python in batches of at most ARROW_ROWS from now on: whole texts are long, and so are their batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def unused(name: str, df: DataFrame) -> str:
    """name, with underscores put before it until no column of df is called so, upper and lower case being one."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def few(df: DataFrame) -> DataFrame:
    """A narrow df in as many partitions as the cluster has cores at most, so that it is written as few files.

    The stage that makes df runs in as few tasks; where it does much work, spread() leaves it its own.
    """
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))


def spread(df: DataFrame) -> DataFrame:
    """few() by a shuffle of the narrow rows, so that the stage before keeps its tasks."""
    return df.repartition(max(1, df.sparkSession.sparkContext.defaultParallelism))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, fresh(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a narrow df in the shared folder; Spark drops its files with the last reference."""
    folder(df.sparkSession)
    return few(df).checkpoint(eager=True)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b): component is the smallest node reachable.

    Alternating star contraction: each round joins narrow pairs with per-node minima, so no node's list is held
    anywhere. Repeated edges, loops and either direction are fine; null ends are ignored; no edges give no rows.
    """
    pairs = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs, seen = cut(pairs), None
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        wide = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = wide.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))
        pairs = cut(wide.join(low, "a").select(F.explode(ends).alias("e"))
                    .select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a != b").distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        pairs.select("b", "b").distinct())


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], often: str, how: str = "inner") -> DataFrame:
    """rows joined with table, whose keys are unique and whose column `often` tells how many rows have the key.

    Keys with over a thousandth of all rows, of which there are under 1000, are joined by broadcast where the rows lie;
    the others by shuffle. No key gathers a large share of the rows in a task. Rows are read twice. how: inner or left.
    """
    most = (table.agg(F.sum(often)).first()[0] or 0) // 1000
    heavy = F.broadcast(table.where(F.col(often) > most).drop(often)) if most >= 100 else None
    light = table.where(F.col(often) <= most).drop(often) if heavy is not None else table.drop(often)
    rest = rows if heavy is None else rows.join(heavy.select(*keys), keys, "left_anti")
    joined = rest.join(light, keys, how)
    return joined if heavy is None else joined.unionByName(rows.join(heavy, keys))


def id_ties(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) between the representatives of all classes (k1, k2, rep) that an id of rows (id, k1, k2) is in: from
    each to the smallest one of the id."""
    several = rows.groupBy("id").agg(*[f(k).alias(f"{f.__name__}_{k}") for k in ("k1", "k2") for f in (F.min, F.max)]).where(
        "min_k1 != max_k1 or min_k2 != max_k2").select("id")
    own = rows.join(several, "id", "left_semi").distinct().join(classes.select("k1", "k2", "rep"), ["k1", "k2"])
    low = own.groupBy("id").agg(F.min("rep").alias("b"), F.count("*").alias("often"))
    return hot_join(own.select("id", F.col("rep").alias("a")), low, ["id"], "often").where("a != b").select("a", "b")


def dealt(rows: DataFrame, group: list[str], member: Column, weight: Column, most: int) -> DataFrame:
    """rows with `task`, `side` and `other`, so that every two rows of a group meet in exactly one task of bounded weight.

    Small groups share tasks by hash. A group heavier than `most` is split by the hash of `member` into parts, and each
    two parts meet in one task of their own: side tells the two apart and is -1 where all rows of a group in the task are
    to be compared. Only sums per group are gathered.
    """
    heavy = F.col("_w") > most
    sums = cut(rows.groupBy(*group).agg(F.sum(weight).alias("_w"), F.count("*").alias("_c")))
    light = sums.where(~heavy).agg(F.sum("_w")).first()[0] or 0
    bins = max(1, math.ceil(light / most * 2))
    parts = F.ceil(F.col("_w") * 2 / most).cast("long")
    keyed = hot_join(rows, sums, group, "_c").withColumn("_p", F.when(heavy, parts).otherwise(F.lit(1))).withColumn(
        "_s", F.pmod(F.xxhash64(F.lit(7), member), F.col("_p")))
    keyed = keyed.withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_p") - 1)))
    name = F.when(heavy, F.concat_ws(":", *[F.col(c).cast("string") for c in group], F.least("_s", "_t").cast("string"),
                                     F.greatest("_s", "_t").cast("string")))
    side = F.when(F.col("_s") == F.col("_t"), -1).when(F.col("_s") < F.col("_t"), 0).otherwise(1)
    small = F.concat(F.lit("s"), F.pmod(F.xxhash64(*group), F.lit(bins)).cast("string"))
    return keyed.withColumn("task", F.coalesce(name, small)).withColumn("side", side.cast("int")).drop(
        "_w", "_p", "_s", "_t")


def stars(ids: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """For a symmetric boolean matrix over ids: (id, smallest id of its component) of each linked id."""
    out, seen = [], np.zeros(len(ids), bool)
    for k in range(len(ids)):
        if seen[k]:
            continue
        mine = np.zeros(len(ids), bool)
        mine[k] = True
        edge = np.array([k])
        while len(edge):
            found = linked[edge].any(axis=0) & ~mine
            mine |= found
            edge = np.nonzero(found)[0]
        seen |= mine
        own = ids[mine]
        out += [(int(x), int(own.min())) for x in own if x != own.min()]
    return out


def slices(batches, rows: int = 128):
    """Arrow batches in pieces of few rows, so that only few texts exist as Python objects at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept between texts up to a bound."""

    MOST = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every `size` consecutive word hashes; of the whole sequence where it is shorter; none for no words."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    out = np.full(len(hashes) - size + 1, size, np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k:len(hashes) - size + 1 + k])
    return out


def alphanumeric_table() -> bytes:
    """For bytes.translate: A-Z to lower case, every other ASCII byte that is no letter or digit to a space."""
    keep = b"0123456789abcdefghijklmnopqrstuvwxyz"
    low = [ord(chr(c).lower()) if c < 128 else c for c in range(256)]
    return bytes(c if c >= 128 or c in keep else 32 for c in low)
