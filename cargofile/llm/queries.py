"""Registered queries of the operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargofile.llm.collocations import collocations
from cargofile.llm.common import lean
from cargofile.llm.contamination import occurrences
from cargofile.llm.cotraining import quality_scores
from cargofile.llm.licenses import license_spans
from cargofile.llm.linededup import dedup_lines
from cargofile.llm.neardup import near_duplicates
from cargofile.llm.oracle import ORACLE  # noqa: F401
from cargofile.llm.packing import pack
from cargofile.llm.secrets import BASE, BlobLedger, of_kind, spans_text
from cargofile.llm.spelling import spelling_variants
from cargofile.llm.toxicity import learn, scored
from cargofile.llm.urls import judged_urls
from cargofile.llm.vectors import near_vectors
from cargofile.llm.warc import read_warc, resolved, warc_files, write_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The tokenizer's file; a parameter of the operator, given here from the installed package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = BlobLedger(spark)
    ledger.update(docs)
    found, base = F.col("found"), [r.kind for r in BASE]
    counts = [F.size(of_kind(found, [k])).cast("long").alias(f"n_{k}") for k in base]
    return ledger.by_path(docs).select("doc_id", *counts, F.sha2(spans_text(of_kind(found, base)), 256).alias("base_sha256"),
                                       spans_text(found).alias("spans"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    return scored(docs, learn(docs.where(~held_out()), labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_spans(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return occurrences(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary())


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    rows = resolved(read_warc(warc_files(spark, root)))
    return rows.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES |= {f.__name__: f for f in (op1_secrets, op2_toxicity, op3_licenses, op4_quality, op5_decontamination, op6_urls,
                                   op7_line_dedup, op8_minhash, op9_embeddings, op10_packing, op11_warc,
                                   op12_collocations, op13_spelling)}
