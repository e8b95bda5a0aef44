"""A training corpus from documents: toxicity, line dedup, near-dedup, decontamination, packing, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargofile.llm.common import BROADCAST_ROWS, fresh, lean
from cargofile.llm.contamination import contaminated
from cargofile.llm.linededup import dedup_lines
from cargofile.llm.neardup import near_duplicates
from cargofile.llm.packing import pack
from cargofile.llm.queries import held_out, table, vocabulary
from cargofile.llm.toxicity import learn, scored


def wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row as one column, so that no column of docs clashes with a result."""
    lean(docs.sparkSession)
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def unwrapped(rows: DataFrame, columns: list[str], **changed) -> DataFrame:
    return rows.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score of at least 0.5) go."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    rows = scored(wrapped(docs), learn(docs.select("doc_id", "text"), labels), into="_toxic")
    return unwrapped(rows.where("_toxic < 0.5"), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text keeps the lines that no document of smaller id holds; n_chars follows. No document goes."""
    return unwrapped(dedup_lines(wrapped(docs)), docs.columns, text=F.col("kept"), n_chars=F.length("kept").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays; rows that repeat an id share its fate."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    few = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go."""
    rows = contaminated(wrapped(docs), table(spark, sf_dir, "benchmark"), keep=["_row"])
    return unwrapped(rows.where("not contaminated"), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as token pieces in sequences."""
    return pack(docs, vocabulary())


STAGES = [
    ("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination),
    ("packing", packing),
]

# A trained classifier, components and a tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
