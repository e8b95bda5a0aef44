"""The three end-to-end jobs over stored tables: convert reports, check files, learn."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cargofile.operators import dedup, enrich, extract, learn as L, lines as N, render, report, resolve, validate
from cargofile.sources import filings as files
from cargofile.sources.shared import cut, kept
from cargofile.sources.tables import MemoryStore


class Converted(NamedTuple):
    records: DataFrame       # deduplicated, repaired, enriched, resolved
    statistics: DataFrame
    errors: DataFrame        # field errors
    adjustments: DataFrame   # audit and rendering events
    problems: DataFrame      # open or unusable resolutions
    unrendered: DataFrame    # records without lines
    blocked: DataFrame       # filings that may not be written, and why
    lines: DataFrame         # numbered lines of all other filings


def prepare_records(extracted: DataFrame, registry: DataFrame | None = None, pairs: DataFrame | None = None,
                    key_cols: tuple[str, ...] = ("filing_id",)) -> DataFrame:
    """Deduplicate, repair receivers, fill ids and names; ``corrigido`` marks changed records."""
    records = cut(validate.repair_receiver(dedup.dedup_merge(extracted, key_cols).drop("chave", "n_registros")))
    records = enrich.fill_documents_and_names(records, registry, pairs)
    return cut(records.withColumn("corrigido", F.col("recebedor_corrigido") | F.col("dados_corrigidos")))


def convert(records: DataFrame, filings: DataFrame, resolutions: DataFrame | None = None, stop: bool = False) -> Converted:
    """Validate, audit, apply human answers and render records from prepare_records().

    A filing with an open or unusable answer, a record that cannot be rendered or an unusable header is
    blocked: it gets no line. With ``stop``, any blocked filing stops the job instead.
    """
    audit = validate.audit_records(records)
    stats = report.run_statistics(records)
    errors = validate.validation_errors(records)
    if resolutions is None:
        problems, solved = validate.pending_documents(records), records
    else:
        problems = resolve.resolution_problems(records, resolutions)
        solved = cut(resolve.apply_resolutions(records, resolutions))
    open_ids = problems.groupBy("filing_id").agg(F.count(F.lit(1)).alias("n")).select(
        "filing_id", F.lit("pendencias").alias("motivo"), "n")
    blocked = cut(render.blocked_filings(solved, filings).unionByName(open_ids))
    if stop:
        require_unblocked(blocked)
    keep = lambda df: df.join(blocked.select("filing_id").distinct(), "filing_id", "left_anti")
    return Converted(
        solved, stats, errors, report.adjustments(audit, render.render_alerts(solved)), problems,
        render.render_errors(solved), blocked, cut(render.numbered_filings(keep(solved), keep(filings))))


def require_unblocked(blocked: DataFrame) -> None:
    """Stop when a filing may not be written, naming the first few."""
    left = blocked.orderBy("filing_id", "motivo").limit(6).collect()
    if left:
        shown = "; ".join(f"{r.filing_id}: {r.motivo} ({r.n})" for r in left[:5]) + ("; ..." if len(left) > 5 else "")
        raise ValueError("filings cannot be written: " + shown)


def write_checked(spark: SparkSession, lines: DataFrame, path: str, strict: bool = True,
                  filings: DataFrame | None = None) -> DataFrame:
    """Write filings and validate what is on disk; returns the verdict per filing.

    With ``filings`` (filing_id, ano, mes, cnpj, relatorio) the folders bear their file names (K2) and so do the
    verdicts; two filings of one name stop the job. The verdicts are of the filings written now.
    """
    if filings is not None:
        names = filings.select("filing_id", render.filing_name(
            F.col("ano"), F.col("mes"), F.col("cnpj"), F.col("relatorio")).alias("arquivo"))
        twice = names.groupBy("arquivo").count().filter("count > 1").orderBy("arquivo").limit(5).collect()
        if twice:
            raise ValueError("one name for several filings: " + ", ".join(r.arquivo for r in twice))
        lines = lines.join(names, "filing_id").drop("filing_id").withColumnRenamed("arquivo", "filing_id")
    lines = kept(lines)
    files.write_filings(lines, path)
    back = files.read_back(spark, path)
    status = N.filing_status(back).join(lines.select("filing_id").distinct(), "filing_id", "left_semi")
    if strict:
        N.require_valid(status, N.top_messages(back))
    return status


def check_files(spark: SparkSession, path: str, file_id: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(verdict per file, first messages per file) of any folder of filing files."""
    checks = files.file_checks(spark, path, file_id)
    own = files.file_errors(checks)
    lines = kept(files.read_filing_lines(spark, path, file_id, strict_utf8=True))
    return N.filing_status(lines, checks.filter("utf8"), own), N.top_messages(lines, checks.filter("utf8"))


def extract_reports(pages: DataFrame, rows: DataFrame, repair: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, rejected reports): a report whose first page lacks a label is left out."""
    checks = extract.check_report_layout(pages)
    bad = checks.filter(~F.col("valido"))
    keep = lambda df: df.join(bad.select("filing_id"), "filing_id", "left_anti")
    return extract.extract_records(keep(pages), keep(rows), repair), bad


def learn_files(spark: SparkSession, lines: DataFrame, store: MemoryStore, origin: str, now: str,
                stream: str | None = None, batch: int = 0) -> dict:
    """Learn from corrected filings; files seen before are skipped.  Returns run counters.

    ``stream`` and ``batch`` are kept with the commit, so that a batch that comes again is known.
    """
    last = store.last_session()
    # A row per file each; stored, for every use would hash or parse all lines again.
    seen = cut(L.replay_filter(L.content_fingerprint(lines), store.sessions()))
    fresh = lines.join(seen.filter(~F.col("replay")).select("filing_id"), "filing_id", "left_semi")
    counts = cut(L.file_counts(fresh).join(seen.select("filing_id", "arquivo_sha256"), "filing_id"))
    if counts.isEmpty():
        return {"replay_detectado": True, "sessao_referencia": seen.agg(F.max("sessao_referencia")).first()[0]}
    memory, found, session = store.pairs(), L.learn_candidates(fresh), last + 1
    snapshot = store.write_pairs(L.classify_pairs(L.upsert_pairs(memory, found, origin, now), found), session)
    items = store.write_items(L.learn_items(memory, found, snapshot), session)
    totals = L.session_report(items).first().asDict()
    store.commit(counts.select(
        F.lit(session).alias("id"), F.col("filing_id").alias("arquivo_txt"), "arquivo_sha256",
        F.lit(now).alias("processado_em"), "total_tn", "candidatos",
        F.lit(totals["aprendidos_novos"]).alias("aprendidos"), F.lit(totals["atualizados"]).alias("atualizados"),
        "ignorados", "linhas_invalidas"), stream, batch)
    return {"replay_detectado": False, **totals}


def learn_new_files(spark: SparkSession, folder: str, store_root: str, checkpoint: str, now: str,
                    file_id: Column | None = None, files_per_batch: int = 1000) -> int:
    """Learn from the files that came to a folder since the last run (J10, J12); returns how many batches were learned.

    A file stream lists the folder; its checkpoint knows the files of earlier runs, and no content is read to find new
    ones.  Each batch of at most ``files_per_batch`` files is learned in one commit of the memory that bears the batch's
    number, so a batch that comes again after a failure between that commit and the stream's own is passed over: every
    file counts exactly once.  A file whose content was learned before counts as a replay.
    """
    name, done = checkpoint.rstrip("/"), []

    def learn(batch: DataFrame, number: int) -> None:
        store = MemoryStore(batch.sparkSession, store_root)
        if store.seen(name, number):
            return
        paths = [r.path for r in batch.select("path").distinct().limit(files_per_batch + 1).collect()]
        lines = kept(files.read_filing_lines(batch.sparkSession, paths, file_id))
        if learn_files(batch.sparkSession, lines, store, name, now, name, number)["replay_detectado"]:
            store.commit(stream=name, batch=number)
        done.append(number)

    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option(
        "recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder).select("path")
    found.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return len(done)
