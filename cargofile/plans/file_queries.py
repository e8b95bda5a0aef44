"""Registered queries over files: reading by byte range, committed writing, stores, streams and registries."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession, functions as F

from cargofile.functions import documents as D
from cargofile.operators import branches as B, enrich as E, learn as L, lines as N, report as P, render as R, validate as V
from cargofile.plans import fixtures, inputs, jobs
from cargofile.plans.file_oracle import CHANGES, QUESTIONS, TERMS
from cargofile.sources import filings as S, tables
from cargofile.sources.shared import by_range, shared_dir

NOW = "2026-01-01T00:00:00"
# Small ranges, so that the lines of one filing come from several.
RANGE_BYTES = 10_007
ROWS_A_FILE = 500
# Every line end that a reader may meet; a line's number says which one it gets.
LINE_ENDS = ("\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " ")


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cargofile-{uuid.uuid4().hex}/{name}"


def _month(c: str = "filing_id"):
    return F.right(c, F.lit(2))


def write_odd_files(spark: SparkSession, sf: str, path: str) -> None:
    """A folder of filing files as other programs leave them: a row per line, which is followed by a line end of any kind
    and a line X; files of April are not UTF-8, those of June start with a BOM."""
    end = F.element_at(F.array(*[F.lit(e) for e in LINE_ENDS]), (F.col("line_no") % len(LINE_ENDS) + 1).cast("int"))
    plain = F.when(_month() == "04", F.lit("\r\n")).otherwise(end)
    bom = F.when((_month() == "06") & (F.col("line_no") == 1), F.lit("﻿")).otherwise("")
    text = F.concat(bom, "value", plain, F.lit("X"))
    # Text of any bytes: the writer puts out what the string holds.
    text = F.when(_month() == "04", F.encode(text, "ISO-8859-1").cast("string")).otherwise(text)
    by_range(inputs.lines(spark, sf).select("filing_id", "line_no", text.alias("value")), "filing_id").sortWithinPartitions(
        "filing_id", "line_no").select("filing_id", "value").write.partitionBy("filing_id").option("lineSep", "\n").text(path)


def _odd_files(spark: SparkSession, sf: str) -> str:
    return inputs.folder(spark, sf, "odd_files", write_odd_files)


def _file_id():
    return F.regexp_extract("path", "filing_id=([^/]+)/", 1)


def read_files(spark, sf):
    """As the validator reads: every line end of text, files that are not UTF-8 left out."""
    return S.read_filing_lines(spark, _odd_files(spark, sf), _file_id(), strict_utf8=True, range_bytes=RANGE_BYTES)


def read_files_legacy(spark, sf):
    """As the parser reads: CR and LF only, cp1252 where a file is not UTF-8."""
    return S.read_filing_lines(spark, _odd_files(spark, sf), _file_id(), range_bytes=RANGE_BYTES)


def file_checks(spark, sf):
    return S.file_checks(spark, _odd_files(spark, sf), _file_id(), RANGE_BYTES).drop("path")


def file_problems(spark, sf):
    return S.file_errors(S.file_checks(spark, _odd_files(spark, sf), _file_id(), RANGE_BYTES))


def write_twice(spark: SparkSession, sf: str, path: str) -> None:
    """All filings in one commit, then those of odd months again, with every second line only."""
    lines = inputs.lines(spark, sf)
    S.write_filings(lines, path, max_lines=ROWS_A_FILE)
    again = lines.filter((_month().cast("int") % 2 == 1) & (F.col("line_no") % 2 == 1))
    S.write_filings(again.withColumn("value", F.concat("value", F.lit(" V2"))), path, max_lines=ROWS_A_FILE)


def _written(spark, sf):
    return inputs.folder(spark, sf, "written", write_twice)


def written_filings(spark, sf):
    return S.read_filing_lines(spark, _written(spark, sf), strict_utf8=True, range_bytes=RANGE_BYTES)


def file_fingerprint(spark, sf):
    return S.file_fingerprint(spark, _written(spark, sf))


def checked_files(spark, sf):
    """The job that checks a folder of files: verdict per file."""
    return jobs.check_files(spark, _odd_files(spark, sf), _file_id())[0]


def _halves(spark, sf):
    lines = inputs.lines(spark, sf)
    return [lines.filter(_month().cast("int") % 2 == odd) for odd in (1, 0)]


def build_store(spark: SparkSession, sf: str, path: str) -> None:
    """Two learning runs, a run over a file that was learned before, compaction and deletion of old versions."""
    first, second = _halves(spark, sf)
    store = tables.MemoryStore(spark, path)
    for part, name in ((first, "lote1"), (second, "lote2"), (first, "de novo")):
        jobs.learn_files(spark, part, store, name, NOW)
    store.compact()
    store.vacuum(keep=1)


def _store(spark, sf):
    return tables.MemoryStore(spark, inputs.folder(spark, sf, "store", build_store))


def memory_store(spark, sf):
    return _store(spark, sf).pairs().drop("primeira_ocorrencia", "ultima_ocorrencia")


def memory_sessions(spark, sf):
    return _store(spark, sf).sessions().select("id", "arquivo_txt", "arquivo_sha256", "total_tn", "candidatos", "ignorados")


def memory_items(spark, sf):
    return _store(spark, sf).items().drop("nf_amostra", "nome_original")


def learn_stream(spark, sf):
    """A folder that grows between two runs of the stream."""
    folder, root = _fresh(spark, "chegadas"), _fresh(spark, "memoria")
    for part in _halves(spark, sf):
        by_range(part, "filing_id").sortWithinPartitions("filing_id", "line_no").select("filing_id", "value").write.mode(
            "append").partitionBy("filing_id").option("lineSep", "\n").text(folder)
        jobs.learn_new_files(spark, folder, root, f"{root}-stream", NOW, _file_id(), files_per_batch=2500)
    return tables.MemoryStore(spark, root).pairs().select(
        "nome_key", "documento", "campo", "tipo_documento", "ocorrencias", "status", "status_motivo")


def _history(spark, sf):
    changes = lambda s, d: fixtures.run_sql(s, d, f"{fixtures.FREIGHT},{CHANGES}", "select * from changes")
    return inputs.stored(spark, sf, "history", lambda s, d: tables.registry_history(inputs.stored(s, d, "changes", changes)))


def registry_history(spark, sf):
    return _history(spark, sf)


def registry_lookup(spark, sf):
    asked = inputs.stored(spark, sf, "questions", lambda s, d: fixtures.run_sql(
        s, d, f"{fixtures.FREIGHT},{QUESTIONS}", "select * from questions"))
    return tables.names_as_of(asked, _history(spark, sf))


def registry_upsert(spark, sf):
    """The history after names of the static registry came in at a later moment, and the registry of a moment before."""
    added = inputs.registry(spark, sf).select("doc", F.concat("nome", F.lit(" nova")).alias("nome"), F.lit(1).alias("ordem"))
    return tables.upsert_registry(_history(spark, sf), added, 20300101)


def registry_then(spark, sf):
    return tables.registry_as_of(tables.upsert_registry(_history(spark, sf), inputs.registry(spark, sf), 20300101), 20170101)


def invoice_positions(spark, sf):
    return P.natural_positions(inputs.records(spark, sf).select("filing_id", "seq", "nf_numero"))


def _with_gaps(spark, sf):
    return inputs.lines(spark, sf).withColumn("value", F.when(F.col("line_no") % 97 != 5, F.col("value")))


def route_lines(spark, sf):
    """All outputs of the router, their fields joined by bars."""
    out, _ = N.route_by_type(_with_gaps(spark, sf), _fresh(spark, "saidas"))
    rows = [out[t.lower()].select("filing_id", "line_no", F.lit(t.lower()).alias("saida"), F.concat_ws(
        "|", *[c for c in out[t.lower()].columns if c not in ("filing_id", "line_no")]).alias("campos")) for t in N.ROUTES]
    rows.append(out["invalid"].select("filing_id", F.col("linha_numero").alias("line_no"), F.lit("invalid").alias("saida"),
                                      F.col("motivo").alias("campos")))
    total = rows[0]
    for df in rows[1:]:
        total = total.unionByName(df)
    return total


def route_counts(spark, sf):
    _, counts = N.route_by_type(_with_gaps(spark, sf), _fresh(spark, "saidas"))
    return spark.createDataFrame(sorted(counts.items()), "saida string, n long")


def forbidden_characters(spark, sf):
    return N.forbidden_characters(inputs.lines(spark, sf))


def layout_messages(spark, sf):
    return N.layout_messages(inputs.lines(spark, sf)).drop("ordem")


def learn_invoices(spark, sf):
    return L.learn_invoices(inputs.lines(spark, sf))


def alert_samples(spark, sf):
    records = inputs.records(spark, sf)
    return P.alert_samples(P.adjustments(V.audit_records(records), R.render_alerts(records)))


def search_branches(spark, sf):
    """Every company's name as a branch, searched by terms of one character and more."""
    places = inputs.stored(spark, sf, "places", lambda s, d: fixtures.run_sql(s, d, fixtures.COMPANY, "select doc as cnpj, nome from company"))
    terms = fixtures.run_sql(spark, sf, f"{fixtures.COMPANY},{TERMS}", "select * from terms")
    return B.search_branches(terms, places)


def list_branches(spark, sf):
    return B.list_branches(inputs.branches(spark, sf))


def loose_documents(spark, sf):
    """How the loose rule reads every id that does not have 11 or 14 digits."""
    docs = E.party_rows(inputs.records(spark, sf)).select(F.coalesce("doc", F.lit("")).alias("doc")).distinct()
    return docs.filter(~F.length("doc").isin(11, 14)).select("doc", D.loose_id(F.col("doc")).alias("solto"))


FILE_QUERIES = {f.__name__: f for f in (
    read_files, read_files_legacy, file_checks, file_problems, checked_files, written_filings, file_fingerprint, memory_store,
    memory_sessions, memory_items, learn_stream, registry_history, registry_lookup, registry_upsert, registry_then,
    invoice_positions, route_lines, route_counts, forbidden_characters, layout_messages, learn_invoices, alert_samples,
    search_branches, list_branches, loose_documents)}

