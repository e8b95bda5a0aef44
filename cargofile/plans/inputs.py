"""Derived input tables, stored once per application and data set.

The operators read records, lines and pages the way a user has them: as tables.  They are
written to the shared folder the cluster names in ``spark.checkpoint.dir``; only where that
is unset (tests, local runs) a temporary folder is made and set.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cargofile.plans import dimensions, fixtures
from cargofile.sources.shared import shared_dir, sized

_stored: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Table ``name`` derived from ``sf_dir``, written on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        path = f"{shared_dir(spark)}/cargofile-{uuid.uuid4().hex}/{name}"
        # Most tables have a row or less per line item; partitions that grow with them are sorted without spilling.
        with sized(spark, spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()):
            build(spark, sf_dir).write.option("compression", "zstd").parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def folder(spark: SparkSession, sf_dir: str, name: str, build) -> str:
    """A folder that ``build(spark, sf_dir, path)`` fills on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        path = f"{shared_dir(spark)}/cargofile-{uuid.uuid4().hex}/{name}"
        build(spark, sf_dir, path)
        _stored[key] = path
    return _stored[key]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "records", fixtures.freight)


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "filings", fixtures.filings)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "lines", fixtures.lines)


def report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "report_pages", fixtures.report_pages)


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "report_rows", fixtures.report_rows)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "registry", dimensions.registry)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "pairs", dimensions.pairs)


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "resolutions", dimensions.resolutions)


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "branches", dimensions.branches)


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "damaged", lambda s, d: fixtures.run_sql(s, d, fixtures.DAMAGED, "select text from damaged"))
