"""Record validation, audit and receiver repair."""

from __future__ import annotations

from functools import reduce
from operator import add, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from cargofile.functions import documents as D, text as X
from cargofile.schema import PARTIES, RECEIVER_MISSING
from cargofile.sources.shared import unfolded

# Limits and message wording of the rules.
NF_PATTERN = "^[0-9]{4,6}$"
CTE_PATTERN = "^[0-9]{1,9}$"
NAME_MIN = 3

LABEL = {"emitente": "CNPJ Emitente", "contratante": "CNPJ Contratante", "destinatario": "CNPJ Destinatário"}
NAME_LABEL = {"emitente": "Nome Emitente", "contratante": "Nome Contratante", "destinatario": "Nome Destinatário"}

ERROR_TYPE = "struct<campo:string,mensagem:string,valor:string,severidade:string>"


class Case(NamedTuple):
    when: Column
    severity: str
    message: Column
    value: Column


class Rule(NamedTuple):
    """Cases are tried in order; the first that fires is the rule's single error."""
    field: str
    cases: tuple[Case, ...]

    def error(self) -> Column:
        out = F.lit(None).cast(ERROR_TYPE)
        for c in reversed(self.cases):
            hit = F.struct(
                F.lit(self.field).alias("campo"), c.message.alias("mensagem"),
                c.value.alias("valor"), F.lit(c.severity).alias("severidade"),
            )
            out = F.when(c.when, hit).otherwise(out)
        return out

    def severity(self) -> Column:
        out = F.lit(None).cast("string")
        for c in reversed(self.cases):
            out = F.when(c.when, F.lit(c.severity)).otherwise(out)
        return out


def _msg(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def prepare(records: DataFrame) -> DataFrame:
    """Add the cleaned helper columns every rule reads (computed once per row)."""
    texts = {f"_{c}": c for c in ("nf_numero", "nf_data", "cte_numero", "cte_data", "recebedor")}
    texts |= {f"_{p}_nome": f"{p}_nome" for p in PARTIES}
    out = X.clean_columns(records, texts).withColumns(
        {f"_{p}_doc": D.document(F.col(f"{p}_cnpj")) for p in PARTIES}).withColumns(
        {f"_{p}_number": D.number(F.col(f"_{p}_doc")) for p in PARTIES})
    return out.withColumns({f"_{p}_{k}_ok": D.number_ok(f"_{p}_doc", f"_{p}_number", size)
                            for p in PARTIES for k, size in (("cnpj", 14), ("cpf", 11))})


def unprepared(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def _date_rule(field: str, name: str, feminine_empty: str, severity: str) -> Rule:
    v = F.col(f"_{field}")
    return Rule(field, (
        Case(v.isNull(), severity, _msg(f"{name} data está {feminine_empty}"), F.lit("")),
        Case(~v.rlike(X.BR_DATE), severity,
             _msg(f"{name} data formato inválido: '", v, "' (esperado: dd/mm/aaaa)"), v),
        Case(~X.is_calendar_date(v), "ERRO",
             _msg(f"{name} data inválida: '", v, "' (data não existe no calendário)"), v),
    ))


def _text_rule(field: str, column: str, label: str, empty: Case | None, short_prefix: str) -> Rule:
    v = F.col(column)
    return Rule(field, (
        empty or Case(v.isNull(), "ERRO", _msg(f"{label} está VAZIO"), F.lit("")),
        Case(F.length(v) < NAME_MIN, "ERRO",
             _msg(f"{short_prefix} muito curto: '", v, f"' (mínimo: {NAME_MIN} caracteres)"), v),
    ))


def _mod11(label: str, kind: str, v: Column) -> Column:
    return _msg(f"{label} {kind} inválido: ", v, " (não passa na validação Módulo 11)")


def rules(check_calendar: bool = True) -> list[Rule]:
    """The eleven rules in reporting order, over prepare()d columns."""
    nf, cte = F.col("_nf_numero"), F.col("_cte_numero")
    out = [
        Rule("nf_numero", (
            Case(nf.isNull(), "CRITICO", _msg("NF número está VAZIO"), F.lit("")),
            Case(~nf.rlike(NF_PATTERN), "CRITICO",
                 _msg("NF número inválido: '", nf, "' (esperado: 4-6 dígitos numéricos)"), nf),
        )),
        _date_rule("nf_data", "NF", "VAZIA", "CRITICO"),
        Rule("cte_numero", (
            Case(cte.isNull(), "ERRO", _msg("CTe número está VAZIO"), F.lit("")),
            Case(~cte.rlike(CTE_PATTERN), "ERRO",
                 _msg("CTe número inválido: '", cte, "' (esperado: 1-9 dígitos numéricos)"), cte),
        )),
        _date_rule("cte_data", "CTe", "VAZIA", "ERRO"),
    ]
    if not check_calendar:
        out = [r._replace(cases=r.cases[:2]) if r.field.endswith("_data") else r for r in out]

    for p in PARTIES:
        d, n, label = F.col(f"_{p}_doc"), F.length(f"_{p}_doc"), LABEL[p]
        cnpj_ok, cpf_ok = F.col(f"_{p}_cnpj_ok"), F.col(f"_{p}_cpf_ok")
        missing = Case(d.isNull(), "CRITICO", _msg(f"{label} está VAZIO"), F.lit(""))
        bad_cnpj = Case((n == 14) & ~cnpj_ok, "CRITICO", _mod11(label, "CNPJ", d), d)
        if p == "emitente":
            cases = (
                missing,
                Case((n == 11) & cpf_ok, "CRITICO",
                     _msg(f"{label} está como CPF (", d, "). Substitua por um CNPJ válido."), d),
                Case(n != 14, "CRITICO",
                     _msg(f"{label} tamanho inválido: ", n.cast("string"), " dígitos (esperado: 14)."), d),
                bad_cnpj,
            )
        else:
            if p == "destinatario":
                missing = missing._replace(
                    when=d.isNull() & ~F.coalesce(F.col("destinatario_exterior"), F.lit(False)))
            cases = (
                missing,
                Case((n == 11) & ~cpf_ok, "CRITICO", _mod11(label, "CPF", d), d),
                bad_cnpj,
                Case(~n.isin(11, 14), "CRITICO",
                     _msg(f"{label} tamanho inválido: ", n.cast("string"),
                          " dígitos (esperado: 11 para CPF ou 14 para CNPJ)"), d),
            )
        out.append(Rule(label, cases))

    out += [_text_rule(NAME_LABEL[p], f"_{p}_nome", NAME_LABEL[p], None, NAME_LABEL[p]) for p in PARTIES]
    out.append(_text_rule(
        "recebedor", "_recebedor", "Recebedor",
        Case(F.col("_recebedor").isNull(), "CRITICO",
             _msg("Recebedor está VAZIO (campo obrigatório)"), F.lit("")),
        "Recebedor",
    ))
    return out


def validation_errors(records: DataFrame, fail_fast: bool = False, check_calendar: bool = True) -> DataFrame:
    """One row per field error; records without errors give none (V0–V8)."""
    found = [r.error() for r in rules(check_calendar)]
    errors = F.array(F.coalesce(*found)) if fail_fast else F.array(*found)
    return (
        unfolded(prepare(records), ["filing_id", "seq", F.coalesce(F.col("nf_numero"), F.lit("N/A")).alias("nf_numero")],
                 errors, "ordem", "e")
        .filter(F.col("e").isNotNull())
        .select("filing_id", "seq", "nf_numero", "ordem", "e.campo", "e.mensagem", "e.valor", "e.severidade")
    )


def with_errors(records: DataFrame, fail_fast: bool = False) -> DataFrame:
    """Records plus ``erros`` (array of field errors); nothing is removed."""
    found = F.array_compact(F.array(*[r.error() for r in rules()]))
    if fail_fast:
        found = F.slice(found, 1, 1)
    return unprepared(prepare(records).withColumn("erros", found))


def with_counts(records: DataFrame) -> DataFrame:
    """Records plus ``n_erros``, ``n_criticos`` and ``n_ajustes`` without building arrays."""
    sev = [r.severity() for r in rules()]
    events = [when for _, when, _, counts in audit_rules() if counts]
    count = lambda flags: reduce(add, [F.when(f, 1).otherwise(0) for f in flags])
    return unprepared(prepare(records).withColumns({
        "n_erros": count([s.isNotNull() for s in sev]),
        "n_criticos": count([s == "CRITICO" for s in sev]),
        "n_ajustes": count(events),
    }))


# --- V9 audit ---------------------------------------------------------------------------

_PARTY_TITLE = {"emitente": "Emitente", "contratante": "Contratante", "destinatario": "Destinatário"}
_PARTY_PLAIN = {"emitente": "Emitente", "contratante": "Contratante", "destinatario": "Destinatario"}


def audit_rules() -> list[tuple[str, Column, Column, bool]]:
    """(type, condition, message, counts as manual adjustment) in reporting order."""
    abroad = F.coalesce(F.col("destinatario_exterior"), F.lit(False))
    out = []
    for p in PARTIES:
        gone = F.col(f"_{p}_doc").isNull()
        if p == "destinatario":
            out.append(("INFO", gone & abroad,
                        _msg("Destinatario exterior sem CPF/CNPJ sera exportado como TI/PI."), False))
            gone = gone & ~abroad
        out.append(("ACAO_NECESSARIA", gone, _msg(f"Documento {_PARTY_PLAIN[p]} ausente no PDF."), True))

    no_num, no_date = F.col("_cte_numero").isNull(), F.col("_cte_data").isNull()
    which = F.concat_ws(" e ", F.when(no_num, "numero"), F.when(no_date, "data"))
    out.append(("ATENCAO", no_num | no_date,
                _msg("CT-e sem ", which, "; a linha CC pode nao ser gerada."), True))

    for p in ("contratante", "destinatario"):
        d = F.col(f"_{p}_doc")
        out.append(("INFO", (F.length(d) == 11) & F.col(f"_{p}_cpf_ok"),
                    _msg(f"{_PARTY_TITLE[p]} com CPF válido (", d,
                         ") será exportado no campo de 14 posições sem zero-fill."), False))

    for p in ("destinatario", "contratante", "emitente"):
        d, nome = F.col(f"_{p}_doc"), F.col(f"_{p}_nome")
        out.append(("ATENCAO", d.isNotNull() & (F.length(F.coalesce(nome, F.lit(""))) < 2),
                    _msg("CNPJ ", d, f" ({_PARTY_TITLE[p]}) está sem nome."), True))

    d, n = F.col("_emitente_doc"), F.length("_emitente_doc")
    as_cpf = (n == 11) & F.col("_emitente_cpf_ok")
    out.append(("ACAO_NECESSARIA", as_cpf,
                _msg("Emitente está como CPF (", d, ") no lugar de CNPJ."), True))
    out.append(("ACAO_NECESSARIA", (n != 14) & ~as_cpf,
                _msg("CNPJ Emitente com tamanho inválido (", n.cast("string"), " dígitos)."), True))
    out.append(("ACAO_NECESSARIA", (n == 14) & ~F.col("_emitente_cnpj_ok"),
                _msg("CNPJ Emitente inválido (", d, ")."), True))
    return out


def audit_records(records: DataFrame) -> DataFrame:
    """Events a human has to look at, one row each, in reporting order (V9)."""
    events = [
        F.when(F.coalesce(cond, F.lit(False)), F.struct(
            F.lit(kind).alias("tipo"), msg.alias("mensagem"), F.lit(counts).alias("conta_ajuste")))
        for kind, cond, msg, counts in audit_rules()
    ]
    return (
        unfolded(prepare(records), ["filing_id", "seq", F.coalesce(F.col("nf_numero"), F.lit("N/A")).alias("nf")],
                 F.array(*events), "ordem", "e")
        .filter(F.col("e").isNotNull())
        .select("filing_id", "seq", "nf", "ordem", "e.tipo", "e.mensagem", "e.conta_ajuste")
    )


# --- V10 receiver repair ----------------------------------------------------------------

# Words written where a receiver's name belongs.
RECEIVER_PLACEHOLDERS = (
    "ASSINATURA", "ASSINADO", "ASSINADO E CARIMBADO", "RUBRICA", "CARIMBO", "ASS", RECEIVER_MISSING,
)


def is_placeholder(cleaned: Column) -> Column:
    up = F.upper(cleaned)
    return F.coalesce(up.isin(*RECEIVER_PLACEHOLDERS) | ~up.rlike("[A-Z0-9]"), F.lit(True))


def repair_receiver(records: DataFrame) -> DataFrame:
    """Replace placeholder receivers; adds ``recebedor_corrigido``."""
    now = X.clean(F.col("recebedor"))
    usable = lambda c: ~is_placeholder(c) & (F.length(c) >= 3)
    pick = F.coalesce(*[
        F.when(usable(X.clean(F.col(f"{p}_nome"))), X.clean(F.col(f"{p}_nome")))
        for p in ("destinatario", "contratante", "emitente")
    ])
    return (
        records.withColumns({"_now": now, "_pick": pick})
        .withColumn("_new", F.when(usable(F.col("_now")), F.col("recebedor"))
                    .otherwise(F.coalesce("_pick", F.when(F.col("_now").isNull(), F.lit(RECEIVER_MISSING))
                                          .otherwise(F.col("recebedor")))))
        .withColumn("recebedor_corrigido",
                    ~usable(F.col("_now")) & (
                        F.col("_now").isNull() | F.coalesce(F.col("_pick") != F.col("_now"), F.lit(False))))
        .withColumn("recebedor", F.col("_new"))
        .drop("_now", "_pick", "_new")
    )


# --- P5 / V12 ---------------------------------------------------------------------------

# Labels of the three id fields at the gate.
PENDING_LABEL = {
    "emitente": "Origem/Emitente", "contratante": "Contratante", "destinatario": "Destino/Destinatario",
}


def _party_rows(records: DataFrame, *extra: str) -> DataFrame:
    """One row per record and party: campo, documento (digits or null), nome."""
    parties = F.array(*[
        F.struct(
            F.lit(p).alias("parte"),
            D.document(F.col(f"{p}_cnpj")).alias("documento"),
            F.col(f"{p}_nome").alias("nome"),
        ) for p in PARTIES
    ])
    return unfolded(records, ["filing_id", "seq", *extra], parties, "p").select(
        "filing_id", "seq", *extra, "p.parte", "p.documento", "p.nome")


def pending_documents(records: DataFrame) -> DataFrame:
    """Records whose party ids still need a human decision (P5)."""
    label = F.create_map(*[F.lit(x) for kv in PENDING_LABEL.items() for x in kv])
    return (
        _party_rows(records, "nf_numero", "destinatario_exterior")
        .filter(F.col("documento").isNull())
        .filter(~((F.col("parte") == "destinatario") & F.coalesce(F.col("destinatario_exterior"), F.lit(False))))
        .select(
            "filing_id", "seq",
            F.coalesce(F.nullif(X.strip(F.col("nf_numero")), F.lit("")), F.lit("N/A")).alias("nf"),
            F.concat("parte", F.lit("_cnpj")).alias("campo"),
            label[F.col("parte")].alias("campo_label"),
            F.coalesce("nome", F.lit("")).alias("nome"),
            (F.col("parte") != "emitente").alias("aceita_cpf"),
            F.lit(False).alias("exterior"),
            F.lit(False).alias("pode_autorizar_vazio"),
        )
    )


def document_quality(records: DataFrame) -> DataFrame:
    """Per filing and id column: rows by id class and by person/company-like name.

    Totals come from one rollup over the already counted rows; ``filing_id`` is null in the
    totals over filings, and the following keys one by one in the wider totals.
    """
    counted = (
        _party_rows(records)
        .select("filing_id", F.concat("parte", F.lit("_cnpj")).alias("campo"),
                D.document_class("documento").alias("classe"),
                F.when(D.looks_like_person(F.col("nome")), "pessoa").otherwise("empresa").alias("nome_parece"))
        .groupBy("filing_id", "campo", "classe", "nome_parece").agg(F.count(F.lit(1)).alias("_n"))
    )
    return counted.rollup("campo", "classe", "nome_parece", "filing_id").agg(F.sum("_n").alias("n"))
