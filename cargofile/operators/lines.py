"""Reading fixed-width lines back: parsing, line rules, cross-line rules, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from cargofile.functions import documents as D, text as X
from cargofile.operators import ordered
from cargofile.schema import LAYOUT, MODALS, WIDTH
from cargofile.sources.shared import cut, kept, sized, unfolded

MAIN_TYPES = ("EM", "TN", "TI")


def _cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def with_type(lines: DataFrame) -> DataFrame:
    """Add ``tipo``: the upper-cased two-character prefix ('' for shorter lines)."""
    v = F.col("value")
    return lines.withColumn("tipo", F.when(F.length(v) >= 2, F.upper(F.left(v, F.lit(2)))).otherwise(""))


def _padded(*types: str) -> Column:
    """The line, padded to the width of its type where it is shorter and of one of ``types``."""
    v = F.col("value")
    return F.coalesce(*[
        F.when((F.col("tipo") == t) & (F.length(v) < WIDTH[t]), F.rpad(v, WIDTH[t], " ")) for t in types], v)


def _fields(tipo: str) -> list[Column]:
    """The positional fields of a _padded() line of one type."""
    fields = []
    for f in LAYOUT[tipo]:
        raw = F.substring("value", f.start, f.length) if f.length else F.expr(f"substr(value, {f.start})")
        fields.append((D.digits_only(raw) if f.kind == "doc" else X.strip(raw)).alias(f.name))
    return fields


def parse_lines(lines: DataFrame, tipo: str) -> DataFrame:
    """Positional fields of all lines of one type (P1); short lines are padded first."""
    typed = with_type(lines).filter(F.col("tipo") == tipo).withColumn("value", _padded(tipo))
    return typed.select("filing_id", "line_no", *_fields(tipo))


ROUTES = ("TN", "CC", "TI", "PI")


def route_by_type(lines: DataFrame, path: str) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """The four typed tables and ``invalid`` (P2), and how many lines went to each and to none (``ignorada``).

    Lines are read once: every line is parsed as its own type only and written under ``path`` in the folder of its
    output; the counts are observed on the way.  An output reads its folder and its columns and nothing else.  A line
    without text is invalid; blank lines and other types are ignored.
    """
    tipo = F.col("tipo")
    saida = F.when(F.col("value").isNull(), "invalid").when(tipo.isin(*ROUTES), F.lower(tipo)).otherwise("ignorada")
    # Padded once a line; fields that pad for themselves cost several times as much.
    routed = with_type(lines).withColumns({"saida": saida, "value": _padded(*ROUTES)}).select(
        "filing_id", "line_no", "saida", *[F.when(tipo == t, F.struct(*_fields(t))).alias(t.lower()) for t in ROUTES])
    seen, names = Observation(), [t.lower() for t in ROUTES] + ["invalid", "ignorada"]
    counted = routed.observe(seen, *[F.count_if(F.col("saida") == n).alias(n) for n in names])
    kept = counted.filter("saida != 'ignorada'")
    kept.write.partitionBy("saida").parquet(path)
    back = lines.sparkSession.read.schema(kept.schema).parquet(path)
    out = {t.lower(): back.filter(F.col("saida") == t.lower()).select("filing_id", "line_no", f"{t.lower()}.*") for t in ROUTES}
    out["invalid"] = back.filter("saida = 'invalid'").select(
        "filing_id", F.col("line_no").alias("linha_numero"), F.lit("linha ilegivel").alias("motivo"))
    return out, {n: seen.get[n] for n in names}


def forbidden_characters(lines: DataFrame) -> DataFrame:
    """filing_id, caractere, n_linhas: the distinct non-ASCII characters of every filing and the lines they occur in.

    A line gives each of its characters once, and tasks count them before anything is shuffled.
    """
    found = lines.select("filing_id", F.explode(X.forbidden_chars(F.col("value"))).alias("caractere"))
    return found.groupBy("filing_id", "caractere").agg(F.count(F.lit(1)).alias("n_linhas"))


def first_invoice(lines: DataFrame) -> DataFrame:
    """Invoice number of the first TN of every filing, null when blank or absent."""
    nf = F.nullif(X.strip(F.substring("value", 87, 10)), F.lit(""))
    is_tn = F.upper(F.left("value", F.lit(2))) == "TN"
    return lines.groupBy("filing_id").agg(
        F.min_by(F.coalesce(nf, F.lit("")), F.when(is_tn, F.col("line_no"))).alias("primeira_nf")
    ).withColumn("primeira_nf", F.nullif("primeira_nf", F.lit("")))


# --- L2 ----------------------------------------------------------------------------------

# 14-position id fields of a line: helper name → first position.
ID_FIELDS = {"_id3": 3, "_id25": 25, "_id107": 107, "_id191": 191}


# Characters without a rule of their own: printable ASCII that is no small letter.
_PLAIN = r"^[ -`{-~]*\z"


def with_id_fields(lines: DataFrame) -> DataFrame:
    """``_n`` (length), ``_odd`` (any character that a rule may be about) and raw text, digits and checksums of the id
    fields, each computed once and only for lines that have the field."""
    n, t = F.col("_n"), F.col("tipo")
    tn = (t == "TN") & (n >= WIDTH["TN"])
    own = {"_id3": tn | ((t == "LA") & (n == WIDTH["LA"])), "_id25": (t == "TI") & (n == WIDTH["TI"]), "_id107": tn, "_id191": tn}
    out = lines.withColumns({"_n": F.length("value"), "_odd": ~F.col("value").rlike(_PLAIN)})
    out = out.withColumns({k: F.when(own[k], F.substring("value", pos, 14)) for k, pos in ID_FIELDS.items()})
    out = out.withColumns({f"{k}_d": D.digits_only(F.col(k)) for k in ID_FIELDS})
    out = out.withColumns({f"{k}_n": D.number(F.col(f"{k}_d")) for k in ID_FIELDS})
    out = out.withColumns(
        {f"{k}_cnpj": D.number_ok(f"{k}_d", f"{k}_n", 14) for k in ID_FIELDS}
        | {f"{k}_cpf": D.number_ok(f"{k}_d", f"{k}_n", 11) for k in ID_FIELDS})
    out = out.withColumns(
        {f"{k}_t": F.when(~F.col(f"{k}_cnpj"), F.right(f"{k}_d", F.lit(11))) for k in ID_FIELDS}
        | {f"{k}_n": F.expr(f"{k}_n % {10 ** 11}L") for k in ID_FIELDS})
    return out.withColumns({f"{k}_tail": D.number_ok(f"{k}_t", f"{k}_n", 11) for k in ID_FIELDS})


def document_field_error(name: str, field: str, accept_cpf: bool) -> Column:
    """Problem of a 14-position id field, or null (L2); reads with_id_fields() columns."""
    raw, d = F.col(name), F.col(f"{name}_d")
    n = F.length(d)
    expected = ("CPF valido (11 digitos) ou CNPJ valido (14 digitos)" if accept_cpf
                else "CNPJ valido (14 digitos)")
    out = (
        F.when(raw.rlike("[^ 0-9]"),
               F.lit(f"{field} contem caracteres invalidos; use apenas digitos e espacos de padding."))
        .when(F.trim(raw) == "", F.lit(f"{field} vazio."))
        .when((n == 14) & F.col(f"{name}_cnpj"), F.lit(None).cast("string"))
        .when((n == 14) & F.col(f"{name}_tail"), _cat(
            f"{field} contem CPF preenchido com zeros a esquerda (", d,
            "); o sistema interpreta esse valor como CNPJ invalido."))
        .when(n == 14, _cat(f"{field} invalido: ", d, "."))
    )
    if accept_cpf:
        out = out.when(n == 11, F.when(~F.col(f"{name}_cpf"), _cat(f"{field} invalido: ", d, ".")))
    return out.otherwise(F.lit(f"{field} deve conter {expected} apos remover espacos."))


def modal_error(modal: Column) -> Column:
    """Problem of the transport-mode list, or null."""
    codes = "|".join(MODALS)
    bad = F.array_join(F.filter(
        F.regexp_extract_all(modal, F.lit("(?s)(.{2})"), 1), lambda b: ~b.isin(*MODALS)), ", ")
    return (
        F.when(modal == "", F.lit("modal de transporte vazio; minimo esperado: RO."))
        .when(F.length(modal) % 2 != 0, _cat(
            "modal de transporte com tamanho invalido (", F.length(modal).cast("string"),
            "). Use codigos concatenados de 2 caracteres."))
        .when(~modal.rlike(f"^({codes})+$"), _cat(
            "modal de transporte invalido: ", bad, f". Valores aceitos: {', '.join(MODALS)}."))
    )


# --- L1 ----------------------------------------------------------------------------------

def _line_rules() -> list[Column]:
    """Messages of one line, null where the rule holds, in reporting order."""
    v, t, n, odd = F.col("value"), F.col("tipo"), F.col("_n"), F.col("_odd")
    at = lambda start, size: F.substring("value", start, size)
    full = lambda tipo: (t == tipo) & (n == WIDTH[tipo])
    size_text = n.cast("string")

    wrong_width = F.coalesce(*[
        F.when((t == k) & (n != WIDTH[k]), _cat("tamanho invalido: ", size_text, f" caracteres (esperado {WIDTH[k]})."))
        for k in ("EM", "LR", "LE", "LA", "TI", "PI")
    ] + [
        F.when((t == "TN") & (n < 86), _cat(
            "linha curta com ", size_text, " caracteres. O campo 'Nome Contratante' ocupa as posicoes 17-86; "
            "o erro oficial costuma aparecer como 'begin 16, end 86, length ", size_text, "'.")),
        F.when((t == "TN") & (n != 276), _cat("tamanho invalido: ", size_text, " caracteres (esperado 276).")),
        F.when((t == "CC") & (n < 103), _cat("tamanho invalido: ", size_text, " caracteres (minimo esperado 103).")),
    ])
    tn = (t == "TN") & (n >= 276)
    place = lambda pos, label: F.when(tn & ~at(pos, 1).isin("P", "A"),
                                      _cat(f"{label} invalido: '", at(pos, 1), "'. Use apenas P ou A."))
    blank = lambda cond, start, size, text: F.when(cond & (X.strip(at(start, size)) == ""), F.lit(text))
    ti, pi, la = full("TI"), full("PI"), full("LA")
    known = t.isin(*WIDTH)
    return [
        F.when(odd & X.has_control(v), F.lit("linha contem caracteres de controle nao imprimiveis.")),
        F.when(odd & X.has_lower(v), F.lit("linha contem letras minusculas; o manual exige dados alfanumericos em MAIUSCULO.")),
        F.when(odd & X.has_non_ascii(v), F.lit("linha contem caracteres nao ASCII/acentuados proibidos pelo manual.")),
        wrong_width,
        F.when(tn, document_field_error("_id3", "CPF/CNPJ Contratante", True)),
        F.when(tn, document_field_error("_id107", "CPF/CNPJ Origem Carga", False)),
        F.when(tn, document_field_error("_id191", "CPF/CNPJ Destino Carga", True)),
        place(275, "Local de Retirada"),
        place(276, "Local de Entrega"),
        F.when((t == "CC") & (n >= 103), modal_error(X.strip(F.expr("substr(value, 102)")))),
        F.when(ti & ~at(3, 1).isin("E", "I"), _cat("Operacao invalida: '", at(3, 1), "'. Use E ou I.")),
        F.when(ti & ~at(4, 1).isin("O", "D"), _cat("Contratante invalido: '", at(4, 1), "'. Use O ou D.")),
        blank(ti, 5, 10, "Numero NF vazio."),
        blank(ti, 39, 70, "Nome da Empresa vazio."),
        F.when(ti, document_field_error("_id25", "CPF/CNPJ Empresa", True)),
        F.when(ti & ~at(109, 1).isin("P", "A"),
               _cat("Local de Armazenamento invalido: '", at(109, 1), "'. Use apenas P ou A.")),
        blank(pi, 3, 70, "Nome Empresa vazio."),
        F.when(pi & (~at(73, 3).rlike("^[0-9]{3}$") | (at(73, 3) == "000")),
               F.lit("Id do pais invalido; use 3 digitos da tabela oficial.")),
        blank(pi, 76, 70, "Endereco completo vazio."),
        F.when(la, document_field_error("_id3", "CPF/CNPJ Empresa", True)),
        blank(la, 17, 70, "Nome Empresa vazio."),
        F.when(~known, _cat("tipo de linha desconhecido: '",
                            F.when(t != "", t).otherwise(F.left(v, F.lit(10))), "'.")),
    ]


def _messages() -> list[Column]:
    """All messages of one line, a blank one's included; null where the rule holds."""
    empty = F.col("value") == ""
    return [F.when(empty, F.lit("linha em branco; cada registro deve ocupar exatamente uma linha.")),
            *[F.when(~empty, m) for m in _line_rules()]]


def line_errors(lines: DataFrame) -> DataFrame:
    """Every rule broken by every line (L1); map-only."""
    return (
        unfolded(with_id_fields(with_type(lines)), ["filing_id", "line_no", "tipo"], F.array(*_messages()), "ordem", "mensagem")
        .filter(F.col("mensagem").isNotNull())
    )


# --- W1, W2, L3 --------------------------------------------------------------------------

def segment_lines(lines: DataFrame) -> DataFrame:
    """Each line with the number, type and text of the main record it belongs to.

    ``owner_no`` is the nearest main line (EM/TN/TI) at or before the line, null before the
    first one.  Works on slices of a filing, never on a whole filing in one task.
    """
    return _with_owner(with_type(lines))


def _main_line() -> Column:
    """Number and type of a main line as one integer, so every aggregate buffer stays fixed-width; null for others."""
    code = F.coalesce(*[F.when(F.col("tipo") == t, F.lit(i)) for i, t in enumerate(MAIN_TYPES)])
    return F.when(code.isNotNull(), F.col("line_no") * 4 + code)


def _owner_columns(owner: str) -> dict[str, Column]:
    names = F.array(*[F.lit(t) for t in MAIN_TYPES])
    return {
        "owner_no": F.floor(F.col(owner) / 4).cast("long"),
        "owner_tipo": F.when(F.col(owner).isNotNull(), F.element_at(names, (F.col(owner) % 4 + 1).cast("int"))),
    }


def _with_owner(typed: DataFrame) -> DataFrame:
    out = ordered.carry_last(typed, ["filing_id"], "line_no", _main_line(), "_owner")
    return out.withColumns(_owner_columns("_owner")).drop("_owner")


# Sub-records a main record can require, and the message when one is missing.
SEGMENT_MESSAGE = {
    "LR": "Local de Retirada = 'A' exige uma subsecao LR antes do proximo TN.",
    "LE": "Local de Entrega = 'A' exige uma subsecao LE antes do proximo TN.",
    "PI": "Transporte Internacional exige uma subsecao PI antes do proximo registro principal.",
    "LA": "Local de Armazenamento = 'A' exige uma subsecao LA antes do proximo registro principal.",
}


def segment_parts(lines: DataFrame, rules: bool = False, rows: int = ordered.SLICE_ROWS) -> DataFrame:
    """What cross-line rules and verdicts need of every segment, from one scan of the lines; stored.

    One narrow row per segment and slice of a filing: owner_no and owner_tipo (null before the first main line), the
    largest ``need_*`` and ``has_*`` flags, ``n`` lines, ``n_em`` of them EM and, where ``rules`` asks for it, ``n_erros``
    line rules broken.  A line that may be an error by itself (a first one that is no EM, PI or LA under no TI of its
    slice) has a row of its own, with line_no and tipo.  Line texts are never shuffled or sorted.
    """
    # Needs come from the main line itself, presence from any line of its segment.
    v, t = F.col("value"), F.col("tipo")
    tn = (t == "TN") & (F.col("_n") >= WIDTH["TN"])
    ti = (t == "TI") & (F.col("_n") >= WIDTH["TI"])
    need = {"LR": tn & (F.substring(v, 275, 1) == "A"), "LE": tn & (F.substring(v, 276, 1) == "A"),
            "PI": ti, "LA": ti & (F.substring(v, 109, 1) == "A")}
    typed = with_type(lines).withColumn("_n", F.length("value"))
    broken = F.lit(0)
    if rules:
        typed = with_id_fields(typed)
        for m in _messages():
            broken = broken + m.isNotNull().cast("int")
    typed = typed.select(
        "filing_id", "line_no", "tipo", broken.alias("n_erros"),
        *[F.when(cond, 1).otherwise(0).alias(f"need_{k}") for k, cond in need.items()])
    part = ["filing_id", "_slice"]
    inner = Window.partitionBy(*part).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    own = ordered.with_slice(typed, ["filing_id"], "line_no", rows, dense=True).withColumn(
        "_own", F.last(_main_line(), ignorenulls=True).over(inner))
    under_ti = F.coalesce(F.col("_own") % 4 == MAIN_TYPES.index("TI"), F.lit(False))
    alone = ((F.col("line_no") == 1) & (t != "EM")) | (t.isin("PI", "LA") & ~under_ti)
    flag = lambda c: F.max(F.when(c, 1).otherwise(0))
    segments = own.withColumns({"_no": F.when(alone, F.col("line_no")), "_tipo": F.when(alone, t)}).groupBy(
        *part, "_own", "_no", "_tipo").agg(
            *[F.max(f"need_{k}").alias(f"need_{k}") for k in SEGMENT_MESSAGE],
            *[flag(t == k).alias(f"has_{k}") for k in SEGMENT_MESSAGE],
            F.count(F.lit(1)).alias("n"), F.count_if(t == "EM").alias("n_em"), F.sum("n_erros").alias("n_erros"))
    with sized(lines.sparkSession, lines.count()):
        parts = cut(segments)
    # The rows before a slice's first main line belong to the last one of the slices before.
    before = Window.partitionBy("filing_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.groupBy(*part).agg(F.max("_own").alias("_end")).select(*part, F.max("_end").over(before).alias("_carry"))
    heads = parts.filter(F.col("_own").isNull()).join(carry, part).withColumn("_own", F.col("_carry")).select(parts.columns)
    out = parts.filter(F.col("_own").isNotNull()).unionByName(heads).withColumns(_owner_columns("_own"))
    return out.withColumnsRenamed({"_no": "line_no", "_tipo": "tipo"}).drop("_slice", "_own")


def dependency_errors(lines: DataFrame, filings: DataFrame | None = None, rows: int = ordered.SLICE_ROWS) -> DataFrame:
    """Cross-line rules (L3).  ``filings`` lists expected filings so that empty ones show up."""
    return _dependencies(segment_parts(lines, rows=rows), filings)


def _dependencies(parts: DataFrame, filings: DataFrame | None) -> DataFrame:
    whole = parts.filter(F.col("owner_tipo").isin("TN", "TI")).groupBy("filing_id", "owner_no", "owner_tipo").agg(
        *[F.max(f"{f}_{k}").alias(f"{f}_{k}") for f in ("need", "has") for k in SEGMENT_MESSAGE])
    rules = F.array(*[
        F.when((F.col(f"need_{t}") == 1) & (F.col(f"has_{t}") == 0), F.lit(text))
        for t, text in SEGMENT_MESSAGE.items()
    ])
    segment_rules = whole.select(
        "filing_id", F.col("owner_no").alias("line_no"), F.col("owner_tipo").alias("tipo"),
        F.explode(rules).alias("mensagem")
    ).filter(F.col("mensagem").isNotNull())

    orphans = parts.filter(F.col("tipo").isin("PI", "LA") & ~F.coalesce(F.col("owner_tipo") == "TI", F.lit(False))).select(
        "filing_id", "line_no", "tipo",
        _cat("subsecao ", F.col("tipo"), " deve estar vinculada a uma linha TI anterior.").alias("mensagem"))

    first = parts.filter((F.col("line_no") == 1) & (F.col("tipo") != "EM")).select(
        "filing_id", F.lit(1).cast("long").alias("line_no"), "tipo",
        F.lit("primeira linha deve ser EM.").alias("mensagem"))

    heads = parts.groupBy("filing_id").agg(F.sum("n_em").alias("n_em"))
    if filings is not None:
        heads = filings.select("filing_id").distinct().join(heads, "filing_id", "left")
    no_lines = F.col("n_em").isNull()
    file_rules = heads.filter(no_lines | (F.col("n_em") != 1)).select(
        "filing_id", F.lit(1).cast("long").alias("line_no"),
        F.when(no_lines, "").otherwise("EM").alias("tipo"),
        F.when(no_lines, F.lit("arquivo sem registros."))
        .otherwise(_cat("arquivo deve conter exatamente 1 linha EM, encontrado: ",
                        F.col("n_em").cast("string"), ".")).alias("mensagem"))
    return file_rules.unionByName(first).unionByName(segment_rules).unionByName(orphans)


# --- L4, T3 ------------------------------------------------------------------------------

def all_errors(lines: DataFrame, filings: DataFrame | None = None) -> DataFrame:
    """Line and dependency errors with a reporting order (line rules first)."""
    own = line_errors(lines).select("filing_id", F.lit(0).alias("fase"), "line_no", "tipo", "ordem", "mensagem")
    dep = dependency_errors(lines, filings).select(
        "filing_id", F.lit(1).alias("fase"), "line_no", "tipo", F.lit(0).alias("ordem"), "mensagem")
    return own.unionByName(dep)


def filing_status(lines: DataFrame, filings: DataFrame | None = None,
                  file_errors: DataFrame | None = None) -> DataFrame:
    """Verdict per filing: total_linhas, n_erros, valido (L4).  Lines are read once."""
    parts = segment_parts(lines, rules=True)
    counts = parts.select("filing_id", "n", "n_erros")
    for errors in (_dependencies(parts, filings), file_errors):
        if errors is not None:
            counts = counts.unionByName(errors.select("filing_id", F.lit(0).alias("n"), F.lit(1).alias("n_erros")))
    return counts.groupBy("filing_id").agg(
        F.sum("n").alias("total_linhas"), F.sum("n_erros").alias("n_erros")
    ).withColumn("valido", F.col("n_erros") == 0)


def _message_text() -> Column:
    return _cat("Linha ", F.col("line_no").cast("string"),
                F.when(F.col("tipo") != "", _cat(" (", F.col("tipo"), ")")).otherwise(""), ": ", F.col("mensagem"))


def layout_messages(lines: DataFrame, filings: DataFrame | None = None) -> DataFrame:
    """Every formatted message of every filing (T3); top_messages() is its first page."""
    return all_errors(lines, filings).select("filing_id", "fase", "line_no", "ordem", _message_text().alias("mensagem"))


def top_messages(lines: DataFrame, filings: DataFrame | None = None, n: int = 20) -> DataFrame:
    """First ``n`` formatted messages per filing, and how many more there are."""
    # Stored, for it is asked twice.
    errors = kept(all_errors(lines, filings))
    total = errors.groupBy("filing_id").agg(F.count(F.lit(1)).alias("_total"))
    first = ordered.top_n(errors, ["filing_id"], ["fase", "line_no", "ordem", "mensagem"], n, "posicao")
    return first.join(total, "filing_id").select(
        "filing_id", "posicao", _message_text().alias("mensagem"),
        F.greatest(F.col("_total") - n, F.lit(0)).alias("adicionais"))


def require_valid(status: DataFrame, messages: DataFrame) -> None:
    """Raise when any filing is invalid, quoting at most 20 messages of one of them."""
    bad = status.filter(~F.col("valido")).select("filing_id").limit(1).collect()
    if bad:
        shown = messages.filter(F.col("filing_id") == bad[0][0]).orderBy("posicao").limit(20).collect()
        raise ValueError("invalid filing " + bad[0][0] + ":\n" + "\n".join(f"- {r.mensagem}" for r in shown))
