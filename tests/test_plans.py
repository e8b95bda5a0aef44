"""What plans must not do: work expressions out again in a filter, shuffle texts of files, keep whole rows of them."""

import re

from helpers import A, foreign, good, lines, records, tn
from pyspark.sql import functions as F

from cargofile.operators import enrich as E, learn as L, lines as N, render as R, report as P, validate as V
from cargofile.plans import jobs
from cargofile.sources import filings as S, ranges, tables
from cargofile.sources.shared import where


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_conditions_on_computed_columns_are_not_copied(spark):
    """A filter below the projections it reads holds copies of their expressions: such plans are two to ten times longer."""
    recs = records(spark, [good(), good(nf_numero="x"), foreign(), good(emitente_cnpj=None)])
    adj = P.adjustments(V.audit_records(recs), R.render_alerts(recs))
    header = spark.createDataFrame([("F1", 2, 2026, A, "r")], "filing_id string, mes int, ano int, cnpj string, relatorio string")
    for df, most in ((P.errors_by_invoice(recs), 40_000), (R.render_errors(recs), 90_000), (R.distinct_valid_companies(recs), 90_000),
                     (R.blocked_filings(recs, header), 90_000), (P.analyst_summary(adj), 90_000), (P.general_notices(adj), 90_000),
                     (P.alert_samples(adj), 90_000), (E.batch_name_index(recs), 6_000), (L.learn_invoices(lines(spark, [tn()])), 11_500)):
        assert len(optimized(df)) < most
    assert {(r.nf, r.n_erros) for r in P.errors_by_invoice(recs).collect()} >= {("x", 1)}


def test_where_is_a_filter(spark):
    df = spark.range(10).select("id", F.when(F.col("id") % 3 == 0, F.col("id") > 4).alias("c"))
    assert sorted(r.id for r in where(df, F.col("c"), "id").collect()) == [6, 9]


def test_alerts_build_no_lines(spark):
    assert "RO" not in re.findall(r"\bRO\b", optimized(R.render_alerts(records(spark, [good()]))))


def test_lines_of_files_are_not_shuffled(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text("".join(f"line {k} {n}\n" for n in range(500)))
    got = S.read_filing_lines(spark, str(tmp_path), F.regexp_extract("path", "([0-9])[.]txt$", 1), range_bytes=50)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    rows = sorted((r.filing_id, r.line_no, r.value) for r in got.collect())
    assert rows == [(str(k), n + 1, f"line {k} {n}") for k in range(3) for n in range(500)]
    assert ranges.line_source(spark, str(tmp_path), "text", 50, summary=True).count() == 3


def test_segments_depend_on_their_file_alone(monkeypatch):
    monkeypatch.setattr(ranges, "TASK_BYTES", 100)
    assert ranges.segment_bytes(30) == 90 and ranges.segment_bytes(300) == 300
    alone = ranges.cut_ranges([("x", None, 0, 250)], 30)
    beside = ranges.cut_ranges([("a", None, 0, 77), ("x", None, 0, 250)], 30)
    cuts = lambda parts: [[r[3] for r in p.ranges if r[0] == "x"] for p in parts if any(r[0] == "x" for r in p.ranges)]
    assert cuts(alone) == cuts(beside) == [[0, 30, 60], [90, 120, 150], [180, 210, 240]]


def test_texts_are_kept_as_columns(spark):
    some = lines(spark, [tn(), tn(nf="9")])
    for df in (L.learn_candidates(some), N.top_messages(some)):
        assert "ExistingRDD" not in optimized(df) and "parquet" in optimized(df)


def test_learning_hashes_lines_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(v):
        seen.add(1)
        return v

    some = lines(spark, [tn(), tn(nf="9")]).withColumn("value", F.udf(count, "string").asNondeterministic()("value"))
    jobs.learn_files(spark, some, tables.MemoryStore(spark, str(tmp_path / "m")), "l", "2026-01-01T00:00:00")
    # Two lines: for the fingerprint, the counts of files (twice, for unreadable lines have their own) and the pairs.
    assert seen.value <= 10
