"""The folder that all of a cluster shares, and stages cut there."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own is made and set only where it is unset (tests, local runs)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        path = tempfile.mkdtemp(prefix="cargofile-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise a stage in the shared checkpoint folder, so later stages do not repeat it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """cut() for tables of many texts: compressed columns in the shared folder instead of whole rows."""
    path = f"{shared_dir(df.sparkSession)}/cargofile-{uuid.uuid4().hex}/kept"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df as the side of a join by shuffle and merge.  Spark tells a table's size from its compressed files, and that of
    exploded rows from what they were exploded from: by that, it sends tables of gigabytes to the driver and all tasks."""
    return df.hint("merge")


# Rows that a task sorts or joins in memory.
TASK_ROWS = 1 << 19


@contextmanager
def sized(spark: SparkSession, rows: int):
    """Shuffles of what runs inside have a partition per TASK_ROWS of ``rows`` rows, or as many as the session has if more."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(int(before), -(-rows // TASK_ROWS))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def by_range(df: DataFrame, *cols: str, rows: int = TASK_ROWS) -> DataFrame:
    """df in ranges of ``cols`` of about ``rows`` rows, or as few ranges as the session has partitions, so that a task
    sorts its rows in memory."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = -(-df.count() // rows)
    return df.repartitionByRange(parts, *cols) if parts > least else df.repartitionByRange(*cols)


def where(df: DataFrame, cond: Column, *cols: str | Column) -> DataFrame:
    """``cols`` of the rows of ``df`` where ``cond`` holds, for conditions on dear computed columns.

    A plain filter is pushed below the projections it reads, with a copy of their expressions for every use; nothing is
    pushed below a generator, so they are worked out once a row.
    """
    return unfolded(df, [], F.array(F.when(cond, F.struct(*cols))), "_row").select("_row.*")


def unfolded(df: DataFrame, keep: list[str | Column], items: Column, *names: str) -> DataFrame:
    """``keep`` and, named by ``names``, (its place and) each element of the array ``items``; an array of nulls gives no row.

    What a generator reads is interpreted node by node, so dear elements are worked out in a projection below it, which is
    compiled.  The generator's input is no plain column: for one, Spark would add a filter that repeats the elements.
    """
    held = df.select(*keep, items.alias("_items"))
    given = F.when(F.exists("_items", lambda x: x.isNotNull()), F.col("_items"))
    rows = F.posexplode(given) if len(names) == 2 else F.explode(given)
    return held.select(*held.columns[:-1], rows.alias(*names))
