"""The registered queries: each runs one group of operators over whole derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cargofile.operators import (
    branches as B, dedup as A, enrich as E, extract as X, learn as L, lines as N, render as R, report as P,
    resolve as Q, validate as V,
)
from cargofile.plans import dimensions as dim, inputs
from cargofile.plans.file_queries import FILE_QUERIES
from cargofile.schema import PAIR_SCHEMA, PARTIES
from cargofile.sources.filings import default_period

# HotSpot never compiles methods beyond 8000 bytes of bytecode; above that size split
# projections are faster than one huge whole-stage method.
TUNING = {"spark.sql.codegen.hugeMethodLimit": "8000"}

NOW = "2026-01-01T00:00:00"


def _odd(lines: DataFrame, odd: bool) -> DataFrame:
    month = F.right("filing_id", F.lit(2)).try_cast("int")
    return lines.filter(month % 2 == (1 if odd else 0))


def document_quality(spark, sf):
    return V.document_quality(inputs.records(spark, sf))


def record_errors(spark, sf):
    return V.validation_errors(inputs.records(spark, sf))


def record_errors_fail_fast(spark, sf):
    return V.validation_errors(inputs.records(spark, sf), fail_fast=True).drop("ordem")


def _statistics(spark, sf):
    return P.run_statistics(V.repair_receiver(inputs.records(spark, sf)).withColumn("corrigido", F.col("recebedor_corrigido")))


def run_statistics(spark, sf):
    return _statistics(spark, sf)


def errors_by_severity(spark, sf):
    return P.errors_by_severity(inputs.records(spark, sf))


def errors_by_invoice(spark, sf):
    return P.errors_by_invoice(inputs.records(spark, sf))


def repair_receiver(spark, sf):
    return V.repair_receiver(inputs.records(spark, sf)).select("filing_id", "seq", "recebedor", "recebedor_corrigido")


def audit_events(spark, sf):
    return V.audit_records(inputs.records(spark, sf)).drop("ordem")


def dedup_merge(spark, sf):
    return A.dedup_merge(inputs.records(spark, sf)).select(
        "filing_id", "chave", "seq", "n_registros", "nf_numero", "nf_data", "emitente_cnpj", "emitente_nome",
        "contratante_cnpj", "contratante_nome", "destinatario_cnpj", "destinatario_nome", "destinatario_exterior",
        "cte_numero", "cte_data", "data_entrega", "recebedor")


def batch_name_index(spark, sf):
    return E.batch_name_index(inputs.records(spark, sf))


def fill_documents(spark, sf):
    out = E.fill_documents_and_names(inputs.records(spark, sf), inputs.registry(spark, sf), inputs.pairs(spark, sf))
    return out.select("filing_id", "seq", *[f"{p}_{k}" for p in PARTIES for k in ("cnpj", "nome")], "n_campos")


def document_sources(spark, sf):
    found = E.fixes(inputs.records(spark, sf), inputs.registry(spark, sf), inputs.pairs(spark, sf))
    return found.groupBy("filing_id", "campo", "origem").agg(F.count(F.lit(1)).alias("n"))


def names_from_registry(spark, sf):
    out = E.fill_documents_and_names(
        inputs.records(spark, sf), inputs.registry(spark, sf), inputs.pairs(spark, sf), infer_documents=False)
    return out.select("filing_id", "seq", *[f"{p}_nome" for p in PARTIES], "n_campos")


def document_known(spark, sf):
    docs = E.party_rows(inputs.records(spark, sf)).filter(F.col("doc").isNotNull()).select("doc").distinct()
    return E.document_known(docs, inputs.registry(spark, sf), inputs.pairs(spark, sf))


def pending_documents(spark, sf):
    return V.pending_documents(inputs.records(spark, sf))


def pending_messages(spark, sf):
    return Q.pending_messages(inputs.records(spark, sf))


def apply_resolutions(spark, sf):
    out = Q.apply_resolutions(inputs.records(spark, sf), inputs.resolutions(spark, sf))
    return out.select("filing_id", "seq", *[f"{p}_cnpj" for p in PARTIES])


def resolution_problems(spark, sf):
    return Q.resolution_problems(inputs.records(spark, sf), inputs.resolutions(spark, sf)).select(
        "filing_id", "nf", "campo", "problema", "mensagem")


def render_lines(spark, sf):
    return R.numbered_filings(inputs.records(spark, sf), inputs.filings(spark, sf))


def complete_filings(spark, sf):
    return R.complete_filings(inputs.records(spark, sf), inputs.filings(spark, sf))


def blocked_filings(spark, sf):
    """Headers as given, and with the year of every fourth filing out of range."""
    heads = inputs.filings(spark, sf)
    heads = heads.withColumn("ano", F.when(F.col("mes") % 4 == 0, 1999).otherwise(F.col("ano")))
    return R.blocked_filings(inputs.records(spark, sf), heads)


def render_errors(spark, sf):
    return R.render_errors(inputs.records(spark, sf))


def render_alerts(spark, sf):
    return R.render_alerts(inputs.records(spark, sf)).drop("ordem")


def distinct_companies(spark, sf):
    return R.distinct_valid_companies(inputs.records(spark, sf))


def infer_country(spark, sf):
    return R.infer_country(inputs.records(spark, sf)).select("filing_id", "seq", "pais_id")


def fix_lines(spark, sf):
    return R.fix_lines(inputs.lines(spark, sf))


def filing_names(spark, sf):
    return inputs.filings(spark, sf).select("filing_id", R.filing_name(
        F.col("ano"), F.col("mes"), F.col("cnpj"), F.col("relatorio")).alias("arquivo"))


def _parsed(tipo):
    return lambda spark, sf: N.parse_lines(inputs.lines(spark, sf), tipo)


def first_invoice(spark, sf):
    return N.first_invoice(inputs.lines(spark, sf))


def line_errors(spark, sf):
    return N.line_errors(inputs.lines(spark, sf)).drop("ordem")


def segment_lines(spark, sf):
    return N.segment_lines(inputs.lines(spark, sf)).select("filing_id", "line_no", "tipo", "owner_no", "owner_tipo")


def dependency_errors(spark, sf):
    return N.dependency_errors(inputs.lines(spark, sf))


def filing_verdict(spark, sf):
    return N.filing_status(inputs.lines(spark, sf))


def top_messages(spark, sf):
    return N.top_messages(inputs.lines(spark, sf), n=3)


def content_fingerprint(spark, sf):
    return L.content_fingerprint(inputs.lines(spark, sf))


def replay_filter(spark, sf):
    lines = inputs.lines(spark, sf)
    copies = lines.filter(F.col("filing_id").endswith("-03")).withColumn("filing_id", F.concat("filing_id", F.lit("-COPIA")))
    files = L.content_fingerprint(lines.unionByName(copies))
    past = L.content_fingerprint(lines.filter(F.col("filing_id").endswith("-05")))
    sessions = past.select(F.substring("filing_id", 2, 2).cast("long").alias("id"), "arquivo_sha256")
    return L.replay_filter(files, sessions).select("filing_id", "replay", "sessao_referencia")


def learn_candidates(spark, sf):
    return L.learn_candidates(inputs.lines(spark, sf))


def learn_file_counts(spark, sf):
    return L.file_counts(inputs.lines(spark, sf))


def _empty_memory(spark):
    return spark.createDataFrame([], PAIR_SCHEMA)


def _first_memory(spark, sf):
    def build(spark, sf):
        return L.learn(_odd(inputs.lines(spark, sf), True), _empty_memory(spark), "lote1", NOW)[0]
    return inputs.stored(spark, sf, "memory", build)


def learn_session(spark, sf):
    return L.learn(_odd(inputs.lines(spark, sf), False), _first_memory(spark, sf), "lote2", NOW)[1].drop("status_final")


def learn_snapshot(spark, sf):
    return L.learn(_odd(inputs.lines(spark, sf), False), _first_memory(spark, sf), "lote2", NOW)[0].drop("primeira_ocorrencia", "ultima_ocorrencia")


def learn_report(spark, sf):
    return L.session_report(L.learn(_odd(inputs.lines(spark, sf), False), _first_memory(spark, sf), "lote2", NOW)[1])


def learn_details(spark, sf):
    return L.session_details(L.learn(_odd(inputs.lines(spark, sf), False), _first_memory(spark, sf), "lote2", NOW)[1])


def classify_pairs(spark, sf):
    return L.classify_pairs(inputs.pairs(spark, sf)).select(
        "nome_key", "documento", "campo", "ocorrencias", "status", "status_motivo")


def memory_summary(spark, sf):
    return L.memory_summary(inputs.pairs(spark, sf), inputs.registry(spark, sf))


def memory_lookup(spark, sf):
    """Every known name asked in every field and without a field."""
    pairs = inputs.pairs(spark, sf)
    by_field = E.memory_documents(pairs).select("key", "campo", F.col("doc_memoria").alias("doc"))
    any_field = E.memory_documents_global(pairs).select("key", F.lit("").alias("campo"), F.col("doc_memoria").alias("doc"))
    return by_field.unionByName(any_field)


def extract_from_text(spark, sf):
    return X.extract_records_from_text(inputs.report_pages(spark, sf)).select(
        "filing_id", "nf_numero", "nf_data", "cte_numero", "cte_data", *[f"{p}_{k}" for p in PARTIES for k in ("cnpj", "nome")],
        "destinatario_exterior", "recebedor")


def extract_records(spark, sf):
    """Tables first, page text for pages without a table record; table numbers of up to 1026."""
    rows = inputs.report_rows(spark, sf)
    rows = rows.filter(F.col("page_no") % 3 != 0).withColumn("table_no", F.when(
        F.col("page_no") % 3 == 1, F.lit(255)).otherwise(F.lit(1026)))
    return X.extract_records(inputs.report_pages(spark, sf), rows).select(
        "filing_id", "seq", "nf_numero", "cte_numero", "emitente_cnpj", "destinatario_exterior")


def layout_check(spark, sf):
    first = inputs.report_pages(spark, sf).groupBy("filing_id").agg(F.min("page_no").alias("page_no"))
    pages = inputs.report_pages(spark, sf).join(first, ["filing_id", "page_no"]).withColumn("page_no", F.lit(1))
    return X.check_report_layout(pages).select("filing_id", F.array_join("faltando", ",").alias("faltando"), "valido")


def extract_from_cells(spark, sf):
    return X.extract_records_from_cells(inputs.report_rows(spark, sf)).select(
        "filing_id", "seq", "nf_numero", "nf_data", "cte_numero", "cte_data", "data_entrega",
        *[f"{p}_{k}" for p in PARTIES for k in ("cnpj", "nome")], "destinatario_exterior", "recebedor")


def repair_ocr_documents(spark, sf):
    return X.repair_documents(inputs.damaged(spark, sf))


def _adjustments(spark, sf):
    records = inputs.records(spark, sf)
    return P.adjustments(V.audit_records(records), R.render_alerts(records))


def analyst_summary(spark, sf):
    return P.analyst_summary(_adjustments(spark, sf))


def analyst_issues(spark, sf):
    return P.analyst_issues(_adjustments(spark, sf))


def operational_alerts(spark, sf):
    return P.operational_alerts(_adjustments(spark, sf))


def general_notices(spark, sf):
    return P.general_notices(_adjustments(spark, sf))


def final_status(spark, sf):
    return P.final_status(_statistics(spark, sf), _adjustments(spark, sf))


def log_consolidation(spark, sf):
    return P.consolidate_log_events(P.log_rows(dim.log_events(spark, sf)))


def log_totals(spark, sf):
    return P.log_totals(P.consolidate_log_events(P.log_rows(dim.log_events(spark, sf))))


def attach_branch(spark, sf):
    return B.attach_branch(inputs.filings(spark, sf), inputs.branches(spark, sf)).select(
        "filing_id", "filial_nome", "filial_existe", "filial_rotulo")


def resolve_branch(spark, sf):
    return B.resolve_branch(dim.requests(spark, sf), inputs.branches(spark, sf)).select("id", "cnpj")


def default_periods(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", default_period(F.col("o_orderdate")).alias("p"))
    return orders.select("o_orderkey", "p.mes", "p.ano")


def _tuned(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for name, value in TUNING.items():
            spark.conf.set(name, value)
        return query(spark, sf_dir)
    return run


QUERIES = {
    "document_quality": document_quality,
    "record_errors": record_errors,
    "record_errors_fail_fast": record_errors_fail_fast,
    "run_statistics": run_statistics,
    "errors_by_severity": errors_by_severity,
    "errors_by_invoice": errors_by_invoice,
    "repair_receiver": repair_receiver,
    "audit_events": audit_events,
    "dedup_merge": dedup_merge,
    "batch_name_index": batch_name_index,
    "fill_documents": fill_documents,
    "document_sources": document_sources,
    "names_from_registry": names_from_registry,
    "document_known": document_known,
    "pending_documents": pending_documents,
    "pending_messages": pending_messages,
    "apply_resolutions": apply_resolutions,
    "resolution_problems": resolution_problems,
    "render_lines": render_lines,
    "complete_filings": complete_filings,
    "blocked_filings": blocked_filings,
    "render_errors": render_errors,
    "render_alerts": render_alerts,
    "distinct_companies": distinct_companies,
    "infer_country": infer_country,
    "fix_lines": fix_lines,
    "filing_names": filing_names,
    "parse_tn": _parsed("TN"),
    "parse_cc": _parsed("CC"),
    "parse_ti": _parsed("TI"),
    "parse_pi": _parsed("PI"),
    "first_invoice": first_invoice,
    "line_errors": line_errors,
    "segment_lines": segment_lines,
    "dependency_errors": dependency_errors,
    "filing_verdict": filing_verdict,
    "top_messages": top_messages,
    "content_fingerprint": content_fingerprint,
    "replay_filter": replay_filter,
    "learn_candidates": learn_candidates,
    "learn_file_counts": learn_file_counts,
    "learn_session": learn_session,
    "learn_snapshot": learn_snapshot,
    "learn_report": learn_report,
    "learn_details": learn_details,
    "classify_pairs": classify_pairs,
    "memory_summary": memory_summary,
    "memory_lookup": memory_lookup,
    "extract_from_text": extract_from_text,
    "extract_from_cells": extract_from_cells,
    "extract_records": extract_records,
    "layout_check": layout_check,
    "repair_ocr_documents": repair_ocr_documents,
    "analyst_summary": analyst_summary,
    "analyst_issues": analyst_issues,
    "operational_alerts": operational_alerts,
    "general_notices": general_notices,
    "final_status": final_status,
    "log_consolidation": log_consolidation,
    "log_totals": log_totals,
    "attach_branch": attach_branch,
    "resolve_branch": resolve_branch,
    "default_periods": default_periods,
}

QUERIES = {name: _tuned(query) for name, query in (QUERIES | FILE_QUERIES).items()}
