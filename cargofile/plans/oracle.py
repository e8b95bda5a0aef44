"""The registered queries as plain SQL (DuckDB dialect), written apart from the operators."""

from __future__ import annotations

from cargofile.functions.documents import CNPJ_WEIGHTS, CPF_WEIGHTS
from cargofile.functions.messages import KINDS, OTHER
from cargofile.plans.dimensions import BRANCHES, LOG, PAIRS, REGISTRY, REQUESTS, RESOLUTIONS
from cargofile.plans.file_oracle import CHANGES, QUESTIONS, TERMS
from cargofile.plans.fixtures import (
    CELLS, COMPANY, DAMAGED, FILINGS, FREIGHT, LINES, REPORTS, _check, duck_sql,
)
from cargofile.schema import COUNTRY_TOKENS, LAYOUT, WIDTH

ORACLE: dict[str, str] = {}
PARTIES = ("emitente", "contratante", "destinatario")
ACCENTED, PLAIN = "ÁÉÍÓÚÂÊÔÃÕÇáéíóúâêôãõç", "AEIOUAEOAOCaeiouaeoaoc"


# --- expression builders -----------------------------------------------------------------

def digits(c):
    return f"regexp_replace({c}, '[^0-9]', '', 'g')"


def clean(c):
    return f"(case when upper(trim({c})) in ('','NONE','NULL','N/A','NA','NAN') then null else trim({c}) end)"


def cnpj_ok(d):
    return (f"(case when length({d}) = 14 and replace({d}, substr({d},1,1), '') <> '' then "
            f"cast(substr({d},13,1) as int) = {_check(d, CNPJ_WEIGHTS[0])} and "
            f"cast(substr({d},14,1) as int) = {_check(d, CNPJ_WEIGHTS[1])} else false end)")


def cpf_ok(d):
    return (f"(case when length({d}) = 11 and replace({d}, substr({d},1,1), '') <> '' then "
            f"cast(substr({d},10,1) as int) = {_check(d, CPF_WEIGHTS[0])} and "
            f"cast(substr({d},11,1) as int) = {_check(d, CPF_WEIGHTS[1])} else false end)")


def key(c):
    return f"coalesce(trim(regexp_replace(translate(upper({c}), '{ACCENTED}', '{PLAIN}'), '[^A-Z0-9]+', ' ', 'g')), '')"


def flat(c):
    t = f"replace(translate({c}, '{ACCENTED}', '{PLAIN}'), '–', '-')"
    return f"trim(regexp_replace(upper({t}), '\\s+', ' ', 'g'))"


def q(text):
    return "'" + text.replace("'", "''") + "'"


def real_date(v):
    part = lambda i: f"split_part({v}, '/', {i})"
    return (f"try_cast(concat({part(3)}, '-', lpad({part(2)}, 2, '0'), '-', lpad({part(1)}, 2, '0')) as date) is not null")


# --- records -----------------------------------------------------------------------------

PREP = f"""{FREIGHT},
prep0 as (
  select *, coalesce(nf_numero, 'N/A') as nf, {clean('nf_numero')} as c_nf, {clean('nf_data')} as c_nfd,
         {clean('cte_numero')} as c_cte, {clean('cte_data')} as c_cted, {clean('recebedor')} as c_rec,
         {', '.join(f"{clean(p + '_nome')} as n_{p}, nullif({digits(p + '_cnpj')}, '') as d_{p}" for p in PARTIES)}
  from freight),
prep as (
  select *, {', '.join(f"{cnpj_ok('d_' + p)} as j_{p}, {cpf_ok('d_' + p)} as f_{p}" for p in PARTIES)} from prep0)"""


def _rules():
    """(ordem, campo, [(condition, severity, message, value)])"""
    def date(f, v, name, sev):
        return (f, [
            (f"{v} is null", sev, f"'{name} data está VAZIA'", "''"),
            (f"not regexp_matches({v}, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}$')", sev,
             f"concat('{name} data formato inválido: ''', {v}, ''' (esperado: dd/mm/aaaa)')", v),
            (f"not ({real_date(v)})", "ERRO",
             f"concat('{name} data inválida: ''', {v}, ''' (data não existe no calendário)')", v)])
    rules = [
        ("nf_numero", [
            ("c_nf is null", "CRITICO", "'NF número está VAZIO'", "''"),
            ("not regexp_matches(c_nf, '^[0-9]{4,6}$')", "CRITICO",
             "concat('NF número inválido: ''', c_nf, ''' (esperado: 4-6 dígitos numéricos)')", "c_nf")]),
        date("nf_data", "c_nfd", "NF", "CRITICO"),
        ("cte_numero", [
            ("c_cte is null", "ERRO", "'CTe número está VAZIO'", "''"),
            ("not regexp_matches(c_cte, '^[0-9]{1,9}$')", "ERRO",
             "concat('CTe número inválido: ''', c_cte, ''' (esperado: 1-9 dígitos numéricos)')", "c_cte")]),
        date("cte_data", "c_cted", "CTe", "ERRO"),
    ]
    labels = {"emitente": "CNPJ Emitente", "contratante": "CNPJ Contratante", "destinatario": "CNPJ Destinatário"}
    for p in PARTIES:
        d, lab = f"d_{p}", labels[p]
        gone = f"{d} is null" + (" and not destinatario_exterior" if p == "destinatario" else "")
        cases = [(gone, "CRITICO", q(f"{lab} está VAZIO"), "''")]
        if p == "emitente":
            cases += [(f"length({d})=11 and f_{p}", "CRITICO",
                       f"concat('{lab} está como CPF (', {d}, '). Substitua por um CNPJ válido.')", d),
                      (f"length({d})<>14", "CRITICO",
                       f"concat('{lab} tamanho inválido: ', cast(length({d}) as string), ' dígitos (esperado: 14).')", d)]
        else:
            cases += [(f"length({d})=11 and not f_{p}", "CRITICO",
                       f"concat('{lab} CPF inválido: ', {d}, ' (não passa na validação Módulo 11)')", d)]
        cases += [(f"length({d})=14 and not j_{p}", "CRITICO",
                   f"concat('{lab} CNPJ inválido: ', {d}, ' (não passa na validação Módulo 11)')", d)]
        if p != "emitente":
            cases += [(f"length({d}) not in (11,14)", "CRITICO",
                       f"concat('{lab} tamanho inválido: ', cast(length({d}) as string), "
                       "' dígitos (esperado: 11 para CPF ou 14 para CNPJ)')", d)]
        rules.append((lab, cases))
    for p, lab in (("emitente", "Nome Emitente"), ("contratante", "Nome Contratante"), ("destinatario", "Nome Destinatário")):
        n = f"n_{p}"
        rules.append((lab, [
            (f"{n} is null", "ERRO", q(f"{lab} está VAZIO"), "''"),
            (f"length({n})<3", "ERRO", f"concat('{lab} muito curto: ''', {n}, ''' (mínimo: 3 caracteres)')", n)]))
    rules.append(("recebedor", [
        ("c_rec is null", "CRITICO", "'Recebedor está VAZIO (campo obrigatório)'", "''"),
        ("length(c_rec)<3", "ERRO", "concat('Recebedor muito curto: ''', c_rec, ''' (mínimo: 3 caracteres)')", "c_rec")]))
    return rules


def _case(cases, i):
    return "case " + " ".join(f"when {c[0]} then {c[i] if i != 1 else q(c[1])}" for c in cases) + " end"


ERRORS = PREP + ", errors as (" + " union all ".join(
    f"select filing_id, seq, nf as nf_numero, {o} as ordem, {q(f)} as campo, {_case(cs, 2)} as mensagem, "
    f"{_case(cs, 3)} as valor, {_case(cs, 1)} as severidade from prep where {' or '.join('(' + c[0] + ')' for c in cs)}"
    for o, (f, cs) in enumerate(_rules())) + ")"

_PLAINNAME = {"emitente": "Emitente", "contratante": "Contratante", "destinatario": "Destinatario"}
_TITLE = {"emitente": "Emitente", "contratante": "Contratante", "destinatario": "Destinatário"}


def _events():
    out = []
    for p in PARTIES:
        if p == "destinatario":
            out.append(("INFO", f"d_{p} is null and destinatario_exterior",
                        "'Destinatario exterior sem CPF/CNPJ sera exportado como TI/PI.'", False))
        extra = " and not destinatario_exterior" if p == "destinatario" else ""
        out.append(("ACAO_NECESSARIA", f"d_{p} is null{extra}", f"'Documento {_PLAINNAME[p]} ausente no PDF.'", True))
    out.append(("ATENCAO", "c_cte is null or c_cted is null",
                "concat('CT-e sem ', case when c_cte is null and c_cted is null then 'numero e data' when c_cte is null then 'numero' "
                "else 'data' end, '; a linha CC pode nao ser gerada.')", True))
    for p in ("contratante", "destinatario"):
        out.append(("INFO", f"length(d_{p})=11 and f_{p}",
                    f"concat('{_TITLE[p]} com CPF válido (', d_{p}, ') será exportado no campo de 14 posições sem zero-fill.')", False))
    for p in ("destinatario", "contratante", "emitente"):
        out.append(("ATENCAO", f"d_{p} is not null and length(coalesce(n_{p},''))<2",
                    f"concat('CNPJ ', d_{p}, ' ({_TITLE[p]}) está sem nome.')", True))
    d = "d_emitente"
    out.append(("ACAO_NECESSARIA", f"length({d})=11 and f_emitente", f"concat('Emitente está como CPF (', {d}, ') no lugar de CNPJ.')", True))
    out.append(("ACAO_NECESSARIA", f"length({d})<>14 and not (length({d})=11 and f_emitente)",
                f"concat('CNPJ Emitente com tamanho inválido (', cast(length({d}) as string), ' dígitos).')", True))
    out.append(("ACAO_NECESSARIA", f"length({d})=14 and not j_emitente", f"concat('CNPJ Emitente inválido (', {d}, ').')", True))
    return out


AUDIT = ", audit as (" + " union all ".join(
    f"select filing_id, seq, nf, {o} as ordem, '{t}' as tipo, {m} as mensagem, {'true' if n else 'false'} as conta_ajuste from prep where {c}"
    for o, (t, c, m, n) in enumerate(_events())) + ")"

PARTY_ROWS = PREP + ", party_rows as (" + " union all ".join(
    f"select filing_id, seq, nf, destinatario_exterior, {i} as f, '{p}' as campo, d_{p} as doc, n_{p} as nome, {p}_nome as bruto, "
    f"{key('n_' + p)} as nome_key from prep" for i, p in enumerate(PARTIES)) + ")"

ORACLE["document_quality"] = duck_sql(PARTY_ROWS + f""",
classed as (
  select filing_id, concat(campo, '_cnpj') as campo,
    case when doc is null then 'vazio' when {cnpj_ok('doc')} then 'cnpj_valido' when {cpf_ok('doc')} then 'cpf_valido'
         when length(doc)=14 and ({cpf_ok('right(doc,11)')} or (substr(doc,1,3)='000' and right(doc,11)<>'00000000000')) then 'cpf_com_zeros'
         when length(doc) in (11,14) then 'checksum_invalido' else 'tamanho_invalido' end as classe,
    case when regexp_matches(concat(' ', upper(trim(coalesce(bruto,''))), ' '),
              '\\s(LTDA|EIRELI|SA|S\\.A\\.|S/A|SOCIEDADE|EMPRESA|COMERCIO|COMÉRCIO|ME|EPP)\\s') then 'empresa' else 'pessoa' end as nome_parece
  from party_rows)""",
    "select filing_id, campo, classe, nome_parece, count(*) as n from classed "
    "group by rollup (campo, classe, nome_parece, filing_id)")
ORACLE["record_errors"] = duck_sql(ERRORS, "select * from errors")
ORACLE["record_errors_fail_fast"] = duck_sql(
    ERRORS, "select * exclude (ordem, rn) from (select *, row_number() over (partition by filing_id, seq order by ordem) as rn from errors) where rn = 1")

RECEIVER = """,
rec0 as (
  select *, c_rec is null or upper(c_rec) in ('ASSINATURA','ASSINADO','ASSINADO E CARIMBADO','RUBRICA','CARIMBO','ASS','NAO INFORMADO')
         or not regexp_matches(upper(c_rec), '[A-Z0-9]') or length(c_rec) < 3 as rec_bad,
         coalesce(case when length(n_destinatario) >= 3 then n_destinatario end, case when length(n_contratante) >= 3 then n_contratante end,
                  case when length(n_emitente) >= 3 then n_emitente end) as pick
  from prep),
rec as (
  select filing_id, seq, case when not rec_bad then recebedor else coalesce(pick, case when c_rec is null then 'NAO INFORMADO' else recebedor end) end as recebedor,
         rec_bad and (c_rec is null or coalesce(pick <> c_rec, false)) as recebedor_corrigido
  from rec0)"""
ORACLE["repair_receiver"] = duck_sql(PREP + RECEIVER, "select * from rec")

# Statistics are taken after the receiver repair, so the receiver rule sees repaired values.
STATS_CTES = (PREP + RECEIVER + ERRORS.replace(PREP, "", 1) + AUDIT + """,
errs2 as (
  select e.filing_id, e.seq, e.severidade from errors e where e.campo <> 'recebedor'
  union all
  select filing_id, seq, case when recebedor is null or trim(recebedor) = '' then 'CRITICO' else 'ERRO' end
  from rec where recebedor is null or length(trim(recebedor)) < 3),
per as (
  select p.filing_id, p.seq, coalesce(e.n, 0) as n_erros, coalesce(e.c, 0) as n_crit, coalesce(a.n, 0) as n_aj, r.recebedor_corrigido as fixed
  from prep p join rec r on p.filing_id = r.filing_id and p.seq = r.seq
  left join (select filing_id, seq, count(*) as n, sum(case when severidade = 'CRITICO' then 1 else 0 end) as c from errs2 group by all) e
    on p.filing_id = e.filing_id and p.seq = e.seq
  left join (select filing_id, seq, count(*) as n from audit where conta_ajuste group by all) a on p.filing_id = a.filing_id and p.seq = a.seq),
stats as (
  select filing_id, count(*) as total_aprovados, cast(sum(case when fixed then 1 else 0 end) as bigint) as total_corrigidos,
    cast(sum(case when n_erros > 0 then 1 else 0 end) as bigint) as total_com_erros,
    cast(sum(case when n_crit > 0 then 1 else 0 end) as bigint) as total_com_erros_criticos,
    cast(sum(n_erros) as bigint) as total_erros_encontrados, cast(sum(n_aj) as bigint) as total_ajustes_manuais
  from per group by filing_id)""")
ORACLE["run_statistics"] = duck_sql(STATS_CTES, """select *, cast(0 as bigint) as total_rejeitados,
  greatest(total_aprovados - total_com_erros_criticos, 0) as sucessos, greatest(total_com_erros_criticos, 0) as falhas,
  false as tem_rejeicoes, total_corrigidos > 0 as tem_correcoes, total_com_erros > 0 as tem_erros,
  total_com_erros_criticos > 0 as tem_erros_criticos from stats""")
ORACLE["errors_by_severity"] = duck_sql(ERRORS, """select filing_id, seq, nf_numero as nf, severidade, count(*) as n,
  string_agg(mensagem, chr(10) order by ordem) as mensagens from errors group by all""")
ORACLE["errors_by_invoice"] = duck_sql(ERRORS + """,
last as (select filing_id, nf_numero, max(seq) as seq from errors group by all)""",
    """select e.filing_id, e.nf_numero as nf, count(*) as n_erros,
  string_agg(concat('[', severidade, '] ', campo, ': ', mensagem), chr(10) order by ordem) as erros
  from errors e join last l on e.filing_id = l.filing_id and e.nf_numero = l.nf_numero and e.seq = l.seq group by all""")
ORACLE["audit_events"] = duck_sql(PREP + AUDIT, "select * exclude (ordem) from audit")

_MERGED = ("nf_numero", "nf_data", "emitente_cnpj", "emitente_nome", "contratante_cnpj", "contratante_nome", "destinatario_cnpj",
           "destinatario_nome", "cte_numero", "cte_data", "data_entrega")
ORACLE["dedup_merge"] = duck_sql(PREP + """,
keyed_rows as (select *, coalesce(c_nf, concat('CTE_', c_cte)) as chave from prep where c_nf is not null or c_cte is not null),
merged as (
  select filing_id, chave, min(seq) as seq, count(*) as n_registros, bool_or(destinatario_exterior) as destinatario_exterior,
  """ + ", ".join(f"arg_min({c}, seq) filter (where {clean(c)} is not null) as {c}" for c in _MERGED + ("recebedor",)) + """
  from keyed_rows group by filing_id, chave)""",
    f"""select * replace (coalesce(recebedor, {clean('destinatario_nome')}, {clean('contratante_nome')}, {clean('emitente_nome')}, 'NAO INFORMADO') as recebedor)
  from merged""")

# --- enrichment --------------------------------------------------------------------------

INDEX = PARTY_ROWS + """,
idx as (
  select filing_id, campo, nome_key, doc, count(*) as n from party_rows
  where length(doc) = 14 and doc <> '00000000000000' and length(nome_key) >= 8 group by all)"""
ORACLE["batch_name_index"] = duck_sql(INDEX, "select * from idx")

_DIMS = "," + REGISTRY + "," + PAIRS
RANKED = """,
ativos as (select campo, nome_key, documento, nome_original, ocorrencias from pairs where status = 'ativo'),
all_fields as (select nome_key, documento, sum(ocorrencias) as ocorrencias, min(nome_original) as nome_original from ativos group by all),
lead_field as (
  select campo, nome_key, arg_max(documento, ocorrencias) as doc, max(ocorrencias) as top, sum(ocorrencias) as total, count(*) as n,
         coalesce(list_sort(list(ocorrencias), 'DESC')[2], 0) as sec from ativos group by all),
mem_field as (
  select campo, nome_key, doc from lead_field
  where (n = 1 or top >= sec + 2) and top >= 2 and top / total >= case campo when 'destinatario' then 0.70 else 0.65 end),
mem_global as (
  select nome_key, doc from (select nome_key, arg_max(documento, ocorrencias) as doc, max(ocorrencias) as top, count(*) as n,
         coalesce(list_sort(list(ocorrencias), 'DESC')[2], 0) as sec from all_fields group by all) where n = 1 or top >= sec + 2),
mem_nome as (
  select documento as doc, nome from (select documento, arg_max(nome_original, ocorrencias) as nome, max(ocorrencias) as top, count(*) as n,
         coalesce(list_sort(list(ocorrencias), 'DESC')[2], 0) as sec from all_fields group by all) where n = 1 or top >= sec + 2)"""
FIXES = INDEX + _DIMS + RANKED + f""",
open_rows as (select * from party_rows where not (campo = 'destinatario' and destinatario_exterior)),
missing as (select * from open_rows where (doc is null or doc = '00000000000000') and length(nome) >= 8),
quest as (select distinct filing_id, campo, nome_key from missing where length(nome_key) >= 8),
ex as (select filing_id, campo, nome_key, case when count(distinct doc) = 1 then min(doc) end as doc from idx group by all),
near as (
  select q.filing_id, q.campo, q.nome_key, case when count(distinct i.doc) = 1 then min(i.doc) end as doc
  from quest q join idx i on q.filing_id = i.filing_id and q.campo = i.campo
    and (contains(q.nome_key, i.nome_key) or contains(i.nome_key, q.nome_key))
  where length(q.nome_key) >= 12 group by all),
reg as (select doc, {key('nome')} as rk from registry),
regkeys as (select distinct nome_key from quest),
reg_ex as (select nome_key, count(*) as n, min(doc) as doc from regkeys join reg on rk = nome_key group by all),
reg_near as (
  select nome_key, count(*) as n, min(doc) as doc from regkeys join reg on
    (contains(nome_key, rk) or contains(rk, nome_key)) and least(length(nome_key), length(rk)) >= 12 group by all),
answers as (
  select q.*, ex.doc as d1, near.doc as d2, coalesce(rx.n, 0) as rn,
         case when coalesce(rx.n, 0) = 1 then rx.doc when coalesce(rx.n, 0) = 0 and rr.n = 1 then rr.doc end as d3, mf.doc as d4
  from quest q left join ex on ex.filing_id = q.filing_id and ex.campo = q.campo and ex.nome_key = q.nome_key
  left join near on near.filing_id = q.filing_id and near.campo = q.campo and near.nome_key = q.nome_key
  left join reg_ex rx on rx.nome_key = q.nome_key left join reg_near rr on rr.nome_key = q.nome_key
  left join mem_field mf on mf.campo = q.campo and mf.nome_key = q.nome_key),
answered as (
  select filing_id, campo, nome_key, coalesce(d1, d2, case when rn > 1 then null else coalesce(d3, d4) end) as doc_novo,
         case when d1 is not null then 'lote_exato' when d2 is not null then 'lote_contido' when d3 is not null then 'registro' else 'memoria' end as origem
  from answers),
nameless as (select * from open_rows where length(doc) = 14 and length(coalesce(nome, '')) < 2),
named as (
  select n.*, coalesce(r.nome, m.nome) as nome_novo from nameless n left join registry r on r.doc = n.doc left join mem_nome m on m.doc = n.doc
  where coalesce(r.nome, m.nome) is not null),
fixes as (
  select filing_id, seq, campo, cast(null as string) as doc_novo, nome_novo, 'nome' as origem from named
  union all
  select m.filing_id, m.seq, m.campo, a.doc_novo, cast(null as string), a.origem
  from missing m join answered a on m.filing_id = a.filing_id and m.campo = a.campo and m.nome_key = a.nome_key where a.doc_novo is not null)"""


def _filled(source, cols):
    new = {f"{p}_cnpj": f"coalesce(x.doc_{p}, f.{p}_cnpj)" for p in PARTIES} | {f"{p}_nome": f"coalesce(x.nome_{p}, f.{p}_nome)" for p in PARTIES}
    picks = ", ".join(f"max(case when campo='{p}' then doc_novo end) as doc_{p}, max(case when campo='{p}' then nome_novo end) as nome_{p}" for p in PARTIES)
    return (f"select f.filing_id, f.seq, {', '.join(new[c] + ' as ' + c for c in cols)}, coalesce(x.n, 0) as n_campos from freight f left join "
            f"(select filing_id, seq, count(*) as n, {picks} from {source} group by all) x on f.filing_id = x.filing_id and f.seq = x.seq")


ORACLE["fill_documents"] = duck_sql(FIXES, _filled("fixes", [f"{p}_{k}" for p in PARTIES for k in ("cnpj", "nome")]))
ORACLE["document_sources"] = duck_sql(FIXES, "select filing_id, campo, origem, count(*) as n from fixes group by all")
ORACLE["names_from_registry"] = duck_sql(FIXES + ", only_names as (select * from fixes where origem = 'nome')",
                                         _filled("only_names", [f"{p}_nome" for p in PARTIES]))
ORACLE["document_known"] = duck_sql(PARTY_ROWS + _DIMS, """select distinct doc,
  doc in (select doc from registry) or doc in (select documento from pairs) as conhecido from party_rows where doc is not null""")
ORACLE["memory_lookup"] = duck_sql(COMPANY + "," + PAIRS + RANKED, """select nome_key as key, campo, doc from mem_field
  union all select nome_key, '', doc from mem_global""")

# --- pendings and resolutions ------------------------------------------------------------

PENDING = PARTY_ROWS + """,
pend as (
  select filing_id, seq, f, coalesce(nullif(trim(nf), ''), 'N/A') as nf, concat(campo, '_cnpj') as campo,
    case campo when 'emitente' then 'Origem/Emitente' when 'contratante' then 'Contratante' else 'Destino/Destinatario' end as campo_label,
    coalesce(bruto, '') as nome, campo <> 'emitente' as aceita_cpf, false as exterior, false as pode_autorizar_vazio
  from party_rows where doc is null and not (campo = 'destinatario' and destinatario_exterior))"""
ORACLE["pending_documents"] = duck_sql(PENDING, "select * exclude (f) from pend")
ORACLE["pending_messages"] = duck_sql(PENDING + """,
ranked as (select *, row_number() over (partition by filing_id order by seq, f) as rn, count(*) over (partition by filing_id) as tot from pend)""",
    """select filing_id, any_value(tot) as n_pendencias, concat(string_agg(concat('NF ', nf, ' (', campo_label, ')'), ', ' order by rn),
  case when any_value(tot) > 5 then concat(', ... +', cast(any_value(tot) - 5 as string)) else '' end) as mensagem
  from ranked where rn <= 5 group by filing_id""")
ANSWERS = PENDING + "," + RESOLUTIONS + f""",
ans0 as (select filing_id, nf_numero as nf, campo, {digits("coalesce(documento, '')")} as documento from resolutions),
ans as materialized (select *, {cnpj_ok('documento')} as okj, {cpf_ok('documento')} as okf from ans0),
pk as materialized (select distinct filing_id, nf, campo, campo_label, aceita_cpf from pend)"""
ORACLE["resolution_problems"] = duck_sql(ANSWERS, """
select filing_id, nf, campo, 'pendencia_inexistente' as problema,
  concat('Documento informado para pendencia inexistente: NF ', nf, ' (', campo, ').') as mensagem
  from ans a anti join pk on pk.filing_id = a.filing_id and pk.nf = a.nf and pk.campo = a.campo
union all
select pk.filing_id, pk.nf, pk.campo, case when a.documento is null then 'documento_faltante' else 'documento_invalido' end,
  case when a.documento is null then concat('NF ', pk.nf, ' (', campo_label, ')')
       else concat('NF ', pk.nf, ': ', campo_label, ' exige ', case when aceita_cpf then 'CPF ou CNPJ valido' else 'CNPJ valido' end, '.') end
  from pk left join ans a on pk.filing_id = a.filing_id and pk.nf = a.nf and pk.campo = a.campo
  where a.documento is null or not (okj or (aceita_cpf and okf))""")
ORACLE["apply_resolutions"] = duck_sql(ANSWERS + """,
hits as (
  select p.filing_id, p.seq, """ + ", ".join(f"max(case when p.campo = '{p}_cnpj' then documento end) as a_{p}" for p in PARTIES) + """
  from pend p join ans a on p.filing_id = a.filing_id and p.nf = a.nf and p.campo = a.campo where okj or (p.aceita_cpf and okf) group by all)""",
    "select f.filing_id, f.seq, " + ", ".join(f"coalesce(a_{p}, {p}_cnpj) as {p}_cnpj" for p in PARTIES) +
    " from freight f left join hits h on f.filing_id = h.filing_id and f.seq = h.seq")

# --- rendering ---------------------------------------------------------------------------

_OPT = ("pais_destino_id", "pais_id", "pais_destino", "pais", "endereco_destinatario", "endereco_internacional", "empresa_cnpj",
        "empresa_nome", "pessoa_internacional_nome", "armazenagem_cnpj", "armazenagem_nome")


def _doc_error(p, field, cpf, accents):
    d, bad, dig = f"d_{p}", "inválido" if accents else "invalido", "dígitos" if accents else "digitos"
    as_cpf = "" if cpf else (f"when length({d})=11 then concat('NF ', shown, ': Documento {field} está como CPF (', {d}, '), mas este campo exige CNPJ.') ")
    return (f"case when {d} is null then concat('NF ', shown, ': Documento {field} vazio no PDF.') {as_cpf}"
            f"when length({d})=11 and not f_{p} then concat('NF ', shown, ': CPF {field} {bad}: ', {d}, '.') "
            f"when length({d})=14 and not j_{p} then concat('NF ', shown, ': CNPJ {field} {bad}: ', {d}, '.') "
            f"when length({d}) not in (11,14) then concat('NF ', shown, ': Documento {field} {bad} (deve ter 11 ou 14 {dig}): ', {d}, '.') end")


def _fit(c, n):
    return f"rpad(coalesce({c}, ''), {n}, ' ')"


_flag = lambda c: f"case when upper(substr(trim({c}),1,1)) in ('P','A') then upper(substr(trim({c}),1,1)) else 'P' end"
_tokens = "coalesce(" + ", ".join(f"case when contains(pais_texto, '{t}') then '{c}' end" for t, c in COUNTRY_TOKENS) + ")"
_code = f"case when length({digits('destinatario_pais_id')}) between 1 and 3 and lpad({digits('destinatario_pais_id')},3,'0') <> '000' then lpad({digits('destinatario_pais_id')},3,'0') end"
_swap = lambda n: f"case when length(n_{n}) >= 5 and not regexp_matches(upper(n_{n}), 'ASSINATURA|RUBRICA') then n_{n} end"
RENDER = PREP + f""",
r0 as (
  select *, coalesce(nullif(trim(nf_numero), ''), 'N/A') as shown, coalesce(n_emitente, n_contratante) as emp_nome,
    coalesce({clean('emitente_cnpj')}, {clean('contratante_cnpj')}) as emp_doc, {_flag('local_retirada')} as fr, {_flag('local_entrega')} as fe,
    {_flag('local_armazenamento')} as fa, coalesce(c_rec, n_destinatario, n_contratante, n_emitente) as rbase,
    {flat("concat_ws(' ', coalesce(destinatario_pais,''), '', '', coalesce(destinatario_nome,''), coalesce(destinatario_texto,''))")} as pais_texto,
    nullif({digits('local_armazenamento_cnpj')}, '') as d_arm, nullif({digits('retirada_cnpj')}, '') as d_ret, nullif({digits('entrega_cnpj')}, '') as d_ent,
    coalesce({clean('destinatario_endereco')}, nullif(trim(regexp_replace(regexp_extract(destinatario_texto, '(?s)END:\\s*(.+?)(\\n\\s*CEP:|$)', 1), '\\s+', ' ', 'g')), '')) as ender
  from prep),
r1 as (
  select *, nullif({digits('emp_doc')}, '') as d_emp,
    coalesce(case when length(rbase) >= 3 then rbase end, case when rbase is not null then
      case when n_destinatario is null then null when length(n_destinatario) >= 3 then n_destinatario
           when n_contratante is not null then case when length(n_contratante) >= 3 then n_contratante end
           when length(n_emitente) >= 3 then n_emitente end end, 'NAO INFORMADO') as rec0,
    upper(substr(coalesce({clean('operacao_internacional')}, 'E'),1,1)) as op, upper(substr(coalesce({clean('contratante_internacional')}, 'O'),1,1)) as pt,
    coalesce({_code}, {_tokens}) as pais_id
  from r0),
r2 as (
  select *, {cnpj_ok('d_emp')} as j_emp, {cpf_ok('d_emp')} as f_emp, {cnpj_ok('d_arm')} as j_arm, {cpf_ok('d_arm')} as f_arm,
    {cnpj_ok('d_ret')} or {cpf_ok('d_ret')} as ok_ret, {cnpj_ok('d_ent')} or {cpf_ok('d_ent')} as ok_ent,
    regexp_matches(upper(rec0), 'ASSINATURA|ASSINADO|RUBRICA|\\bASS\\b') as m_sig, length(rec0) < 5 as m_short,
    regexp_matches(rec0, '\\b[0-9]{{11}}\\b') as m_cpf, rec0 = 'NAO INFORMADO' as m_none
  from r1),
r3 as (
  select *, concat_ws(', ', case when m_sig then 'texto de assinatura/rubrica' end, case when m_short then 'muito curto' end,
      case when m_cpf then 'contém CPF' end, case when m_none then 'não informado' end) as motivos,
    case when m_sig or m_cpf or m_none then coalesce({_swap('destinatario')}, {_swap('contratante')}, {_swap('emitente')}) end as troca,
    case when destinatario_exterior then coalesce(
      case when op not in ('E','I') then concat('NF ', shown, ': Operacao internacional invalida: ', op, '.') end,
      case when pt not in ('O','D') then concat('NF ', shown, ': Contratante internacional invalido: ', pt, '.') end,
      {_doc_error('emp', 'Empresa', True, False)},
      case when emp_nome is null then concat('NF ', shown, ': Nome da Empresa vazio para TI.') end,
      case when fa = 'A' then {_doc_error('arm', 'Armazenagem', True, False)} end,
      case when fa = 'A' and {clean('local_armazenamento_nome')} is null then concat('NF ', shown, ': Nome da Armazenagem vazio para LA.') end,
      case when n_destinatario is null then concat('NF ', shown, ': Nome da Pessoa Internacional vazio.') end,
      case when pais_id is null then concat('NF ', shown, ': destino exterior sem Id do pais. Informe destinatario_pais_id com 3 digitos.') end,
      case when ender is null then concat('NF ', shown, ': destino exterior sem endereco internacional. O registro PI exige Endereco completo.') end)
    else coalesce({_doc_error('contratante', 'Contratante', True, True)}, {_doc_error('emitente', 'Origem (Emitente)', False, True)},
      {_doc_error('destinatario', 'Destino (Destinatário)', True, True)}) end as erro,
    {digits('c_cte')} as ctd, case when regexp_matches(coalesce(c_nf,''), '^0+$') then '0' else regexp_replace(coalesce(c_nf,''), '^0+', '') end as nf_l
  from r2),
r4 as (
  select *, case when length(ctd) < 9 then lpad(ctd, 9, '0') else ctd end as ct9, {_fit("regexp_replace(upper(nf_l), '[^A-Z0-9]', '', 'g')", 10)} as nf10,
    erro is null and not destinatario_exterior as nac, erro is null and destinatario_exterior as ext from r3),
r5 as (
  select *, case when nac and c_cte is not null then
      case when ct9 = '000000000' then 'CTe número inválido (apenas zeros).' when c_cted is null then 'CTe data inválida ou não encontrada.'
           when length(ct9) <> 9 then concat('Linha CC deve ter exatamente 103 caracteres, mas tem ', cast(length(ct9) + 94 as string), '.') end end as erro_cc
  from r4),
rendered as (
  select filing_id, seq, 1 as sub, 'TN' as tipo, concat('TN', lpad(d_contratante,14,' '), {_fit(flat('n_contratante'),70)}, nf10, {_fit(flat('c_nfd'),10)},
    lpad(d_emitente,14,' '), {_fit(flat('n_emitente'),70)}, lpad(d_destinatario,14,' '), {_fit(flat('n_destinatario'),70)}, fr, fe) as value from r5 where nac
  union all
  select filing_id, seq, 2, 'CC', concat('CC', ct9, {_fit(flat('c_cted'),10)}, {_fit('coalesce(' + flat(clean('data_entrega')) + ', substr(' + flat('c_cted') + ',1,10))',10)},
    {_fit(flat('coalesce(troca, rec0)'),70)}, 'RO') from r5 where nac and c_cte is not null and erro_cc is null
  union all
  select filing_id, seq, 3, 'LR', concat('LR', lpad(d_ret,14,' '), {_fit(flat(clean('retirada_nome')),70)}) from r5 where nac and fr = 'A' and ok_ret and {clean('retirada_nome')} is not null
  union all
  select filing_id, seq, 4, 'LE', concat('LE', lpad(d_ent,14,' '), {_fit(flat(clean('entrega_nome')),70)}) from r5 where nac and fe = 'A' and ok_ent and {clean('entrega_nome')} is not null
  union all
  select filing_id, seq, 5, 'TI', concat('TI', op, pt, nf10, {_fit(flat('c_nfd'),10)}, lpad(d_emp,14,' '), {_fit(flat('emp_nome'),70)}, fa) from r5 where ext
  union all
  select filing_id, seq, 6, 'LA', concat('LA', lpad(d_arm,14,' '), {_fit(flat(clean('local_armazenamento_nome')),70)}) from r5 where ext and fa = 'A'
  union all
  select filing_id, seq, 7, 'PI', concat('PI', {_fit(flat('n_destinatario'),70)}, pais_id, {_fit(flat('ender'),70)}) from r5 where ext)"""
_MONTHCASE = "(case mes when 1 then 'JAN' when 2 then 'FEV' when 3 then 'MAR' when 4 then 'ABR' when 5 then 'MAI' when 6 then 'JUN' when 7 then 'JUL' when 8 then 'AGO' when 9 then 'SET' when 10 then 'OUT' when 11 then 'NOV' when 12 then 'DEZ' end)"
ORACLE["render_lines"] = duck_sql(RENDER + "," + FILINGS, f"""
select filing_id, row_number() over (partition by filing_id order by o) as line_no, tipo, value from (
  select filing_id, seq * 8 + sub as o, tipo, value from rendered
  union all
  select filing_id, 0, 'EM', concat('EM', cnpj, {_MONTHCASE}, cast(ano as string), '00000010') from filings)""")
ORACLE["complete_filings"] = duck_sql(RENDER + "," + FILINGS + ", bad as (select distinct filing_id from r5 where erro is not null)", f"""
select filing_id, row_number() over (partition by filing_id order by o) as line_no, tipo, value from (
  select filing_id, seq * 8 + sub as o, tipo, value from rendered
  union all
  select filing_id, 0, 'EM', concat('EM', cnpj, {_MONTHCASE}, cast(ano as string), '00000010') from filings) every
where filing_id not in (select filing_id from bad)""")
ORACLE["blocked_filings"] = duck_sql(RENDER + "," + FILINGS, """
select filing_id, 'registros' as motivo, count(*) as n from r5 where erro is not null group by filing_id
union all select filing_id, 'cabecalho', 1 from filings where mes % 4 = 0""")
ORACLE["render_errors"] = duck_sql(RENDER, """select filing_id, seq, nf, case when destinatario_exterior then 'TI/PI' else 'TN' end as linha, erro as mensagem
  from r5 where erro is not null""")


def _alert_rows():
    def name(p, label):
        return ("ACAO_NECESSARIA", f"not destinatario_exterior and n_{p} is null",
                f"concat('NF ', shown, ': {label} vazio no TXT (CNPJ ', coalesce(d_{p}, 'N/A'), '). Preencha manualmente no arquivo gerado.')")
    kind = "case when length(d_contratante)=11 then 'CPF' else 'CNPJ' end"
    head = "concat('NF ', shown, ': Recebedor suspeito (', motivos, '): ''', rec0, '''. ')"
    return [
        ("ATENCAO", "not destinatario_exterior and d_contratante = d_destinatario and length(d_contratante) in (11,14) and d_contratante not in ('00000000000000','00000000000')",
         f"concat('NF ', shown, ': ', {kind}, ' Contratante (', d_contratante, ') igual ao ', {kind}, ' Destino. Isso pode causar erro no envio.')"),
        name("contratante", "Nome Contratante"), name("emitente", "Nome Emitente"), name("destinatario", "Nome Destinatário"),
        ("ATENCAO", "motivos <> '' and nac and c_cte is not null and (erro_cc is null or length(c_cte) > 9)",
         f"concat({head}, case when troca is not null then concat('Substituído por ''', troca, '''.') else 'Verifique e ajuste manualmente se necessário.' end)"),
        ("ALERTA", "erro_cc is not null", "concat('AVISO: Linha CC não gerada para NF ', shown, ': ', erro_cc, ' A linha TN foi gerada com sucesso, mas a linha CC correspondente foi pulada.')"),
        ("ATENCAO", "ext", "concat('NF ', shown, ': Destinatario exterior sem CPF/CNPJ gerado como Transporte Internacional (TI/PI).')"),
    ]


ALERTS = RENDER + ", alerts as (" + " union all ".join(
    f"select filing_id, seq, shown as nf, {i} as ordem, '{t}' as tipo, {m} as mensagem from r5 where {c}" for i, (t, c, m) in enumerate(_alert_rows())) + ")"
ORACLE["render_alerts"] = duck_sql(ALERTS, "select * exclude (ordem) from alerts")
ORACLE["distinct_companies"] = duck_sql(RENDER, "select filing_id, count(distinct d) as cnpjs_distintos from (" + " union all ".join(
    f"select filing_id, d_{p} as d from r5 where erro is null and j_{p}" for p in PARTIES) + ") group by filing_id")
ORACLE["infer_country"] = duck_sql(RENDER, "select filing_id, seq, pais_id from r5 where destinatario_exterior")
ORACLE["filing_names"] = duck_sql(FREIGHT + "," + FILINGS, f"""select filing_id, concat('M', cast(ano as string), {_MONTHCASE}, cnpj, '_',
  substr(trim(regexp_replace(upper(translate(regexp_replace(regexp_replace(relatorio, '^.*/', ''), '\\.[^.]*$', ''), '{ACCENTED}', '{PLAIN}')), '[^A-Z0-9]+', '_', 'g'), '_'), 1, 30), '.txt') as arquivo
  from filings""")

# --- lines -------------------------------------------------------------------------------

TYPED = LINES + ", typed as (select *, case when length(value) >= 2 then upper(substr(value,1,2)) else '' end as tipo, length(value) as n from lines)"


def _parse(tipo):
    v = f"(case when n < {WIDTH[tipo]} then rpad(value, {WIDTH[tipo]}, ' ') else value end)"
    cols = []
    for f in LAYOUT[tipo]:
        raw = f"substr({v}, {f.start}, {f.length})" if f.length else f"substr({v}, {f.start})"
        cols.append((digits(raw) if f.kind == "doc" else f"trim({raw}, ' ')") + f" as {f.name}")
    return f"select filing_id, line_no, {', '.join(cols)} from typed where tipo = '{tipo}'"


for _t in ("TN", "CC", "TI", "PI"):
    ORACLE[f"parse_{_t.lower()}"] = duck_sql(TYPED, _parse(_t))
ORACLE["first_invoice"] = duck_sql(TYPED, """select filing_id, nullif(arg_min(trim(substr(value, 87, 10)), line_no) filter (where tipo = 'TN'), '') as primeira_nf
  from typed group by filing_id""")


def _field(pos, label, cpf):
    raw = f"substr(value, {pos}, 14)"
    d = digits(raw)
    exp = "CPF valido (11 digitos) ou CNPJ valido (14 digitos)" if cpf else "CNPJ valido (14 digitos)"
    person = f"when length(d{pos})=11 and pf{pos} then null when length(d{pos})=11 then concat('{label} invalido: ', d{pos}, '.') " if cpf else ""
    return (f"case when regexp_matches({raw}, '[^ 0-9]') then '{label} contem caracteres invalidos; use apenas digitos e espacos de padding.' "
            f"when trim({raw}) = '' then '{label} vazio.' when length(d{pos})=14 and pj{pos} then null "
            f"when length(d{pos})=14 and pt{pos} then concat('{label} contem CPF preenchido com zeros a esquerda (', d{pos}, '); o sistema interpreta esse valor como CNPJ invalido.') "
            f"when length(d{pos})=14 then concat('{label} invalido: ', d{pos}, '.') {person}else '{label} deve conter {exp} apos remover espacos.' end")


_POS = (3, 25, 107, 191)
LINE_ERRORS = TYPED + ", t1 as (select *, " + ", ".join(f"{digits(f'substr(value,{p},14)')} as d{p}" for p in _POS) + " from typed), t2 as (select *, " + ", ".join(
    f"{cnpj_ok(f'd{p}')} as pj{p}, {cpf_ok(f'd{p}')} as pf{p}, {cpf_ok(f'right(d{p},11)')} as pt{p}" for p in _POS) + ", trim(substr(value, 102)) as modal from t1), line_err as ("


def _width(t):
    return f"concat('tamanho invalido: ', cast(n as string), ' caracteres (esperado {WIDTH[t]}).')"


_AT = lambda p, k=1: f"substr(value, {p}, {k})"
_ROWS = [
    ("value = ''", "'linha em branco; cada registro deve ocupar exatamente uma linha.'"),
    ("regexp_matches(value, '[\\x00-\\x1f\\x7f]')", "'linha contem caracteres de controle nao imprimiveis.'"),
    ("regexp_matches(value, '[a-z]')", "'linha contem letras minusculas; o manual exige dados alfanumericos em MAIUSCULO.'"),
    ("strlen(value) <> length(value)", "'linha contem caracteres nao ASCII/acentuados proibidos pelo manual.'"),
] + [(f"tipo = '{t}' and n <> {WIDTH[t]}", _width(t)) for t in ("EM", "LR", "LE", "LA", "TI", "PI")] + [
    ("tipo = 'TN' and n < 86", "concat('linha curta com ', cast(n as string), ' caracteres. O campo ''Nome Contratante'' ocupa as posicoes 17-86; o erro oficial costuma aparecer como ''begin 16, end 86, length ', cast(n as string), '''.')"),
    ("tipo = 'TN' and n >= 86 and n <> 276", _width("TN")),
    ("tipo = 'CC' and n < 103", "concat('tamanho invalido: ', cast(n as string), ' caracteres (minimo esperado 103).')"),
    ("tipo = 'TN' and n >= 276", _field(3, "CPF/CNPJ Contratante", True)),
    ("tipo = 'TN' and n >= 276", _field(107, "CPF/CNPJ Origem Carga", False)),
    ("tipo = 'TN' and n >= 276", _field(191, "CPF/CNPJ Destino Carga", True)),
    (f"tipo = 'TN' and n >= 276 and {_AT(275)} not in ('P','A')", f"concat('Local de Retirada invalido: ''', {_AT(275)}, '''. Use apenas P ou A.')"),
    (f"tipo = 'TN' and n >= 276 and {_AT(276)} not in ('P','A')", f"concat('Local de Entrega invalido: ''', {_AT(276)}, '''. Use apenas P ou A.')"),
    ("tipo = 'CC' and n >= 103", "case when modal = '' then 'modal de transporte vazio; minimo esperado: RO.' "
     "when length(modal) % 2 <> 0 then concat('modal de transporte com tamanho invalido (', cast(length(modal) as string), '). Use codigos concatenados de 2 caracteres.') "
     "when not regexp_matches(modal, '^(AE|AQ|FE|RO)+$') then concat('modal de transporte invalido: ', "
     "list_aggregate(list_filter(regexp_extract_all(modal, '..'), lambda b: b not in ('AE','AQ','FE','RO')), 'string_agg', ', '), '. Valores aceitos: AE, AQ, FE, RO.') end"),
    (f"tipo = 'TI' and n = 109 and {_AT(3)} not in ('E','I')", f"concat('Operacao invalida: ''', {_AT(3)}, '''. Use E ou I.')"),
    (f"tipo = 'TI' and n = 109 and {_AT(4)} not in ('O','D')", f"concat('Contratante invalido: ''', {_AT(4)}, '''. Use O ou D.')"),
    (f"tipo = 'TI' and n = 109 and trim({_AT(5, 10)}) = ''", "'Numero NF vazio.'"),
    (f"tipo = 'TI' and n = 109 and trim({_AT(39, 70)}) = ''", "'Nome da Empresa vazio.'"),
    ("tipo = 'TI' and n = 109", _field(25, "CPF/CNPJ Empresa", True)),
    (f"tipo = 'TI' and n = 109 and {_AT(109)} not in ('P','A')", f"concat('Local de Armazenamento invalido: ''', {_AT(109)}, '''. Use apenas P ou A.')"),
    (f"tipo = 'PI' and n = 145 and trim({_AT(3, 70)}) = ''", "'Nome Empresa vazio.'"),
    (f"tipo = 'PI' and n = 145 and (not regexp_matches({_AT(73, 3)}, '^[0-9]{{3}}$') or {_AT(73, 3)} = '000')".replace("{{", "{").replace("}}", "}"), "'Id do pais invalido; use 3 digitos da tabela oficial.'"),
    (f"tipo = 'PI' and n = 145 and trim({_AT(76, 70)}) = ''", "'Endereco completo vazio.'"),
    ("tipo = 'LA' and n = 86", _field(3, "CPF/CNPJ Empresa", True)),
    (f"tipo = 'LA' and n = 86 and trim({_AT(17, 70)}) = ''", "'Nome Empresa vazio.'"),
    ("value <> '' and tipo not in ('EM','TN','CC','TI','LA','LR','LE','PI')", "concat('tipo de linha desconhecido: ''', case when tipo <> '' then tipo else substr(value,1,10) end, '''.')"),
]
LINE_ERRORS += " union all ".join(
    f"select * from (select filing_id, line_no, tipo, {i} as ordem, {m} as mensagem from t2 where {c}) where mensagem is not null" for i, (c, m) in enumerate(_ROWS)) + ")"
ORACLE["line_errors"] = duck_sql(LINE_ERRORS, "select * exclude (ordem) from line_err")

SEG = """,
seg as (select *, last_value(case when tipo in ('EM','TN','TI') then line_no end ignore nulls) over (partition by filing_id order by line_no rows unbounded preceding) as owner_no from typed),
seg2 as (select s.*, o.tipo as owner_tipo, o.value as ov, o.n as on_ from seg s left join typed o on s.filing_id = o.filing_id and s.owner_no = o.line_no)"""
ORACLE["segment_lines"] = duck_sql(TYPED + SEG, "select filing_id, line_no, tipo, owner_no, owner_tipo from seg2")
DEP = SEG + """,
parts as (select filing_id, owner_no, any_value(owner_tipo) as tipo, any_value(ov) as v, any_value(on_) as w,
  bool_or(tipo='LR') as lr, bool_or(tipo='LE') as le, bool_or(tipo='PI') as pi, bool_or(tipo='LA') as la from seg2 where owner_tipo in ('TN','TI') group by filing_id, owner_no),
dep as (
  select filing_id, cast(1 as bigint) as line_no, 'EM' as tipo, concat('arquivo deve conter exatamente 1 linha EM, encontrado: ', cast(count(*) filter (where tipo='EM') as string), '.') as mensagem
  from typed group by filing_id having count(*) filter (where tipo='EM') <> 1
  union all select filing_id, line_no, tipo, 'primeira linha deve ser EM.' from typed where line_no = 1 and tipo <> 'EM'
  union all select filing_id, owner_no, tipo, 'Local de Retirada = ''A'' exige uma subsecao LR antes do proximo TN.' from parts where tipo='TN' and w >= 276 and substr(v,275,1)='A' and not lr
  union all select filing_id, owner_no, tipo, 'Local de Entrega = ''A'' exige uma subsecao LE antes do proximo TN.' from parts where tipo='TN' and w >= 276 and substr(v,276,1)='A' and not le
  union all select filing_id, owner_no, tipo, 'Transporte Internacional exige uma subsecao PI antes do proximo registro principal.' from parts where tipo='TI' and w >= 109 and not pi
  union all select filing_id, owner_no, tipo, 'Local de Armazenamento = ''A'' exige uma subsecao LA antes do proximo registro principal.' from parts where tipo='TI' and w >= 109 and substr(v,109,1)='A' and not la
  union all select filing_id, line_no, tipo, concat('subsecao ', tipo, ' deve estar vinculada a uma linha TI anterior.') from seg2 where tipo in ('PI','LA') and coalesce(owner_tipo,'') <> 'TI')"""
ORACLE["dependency_errors"] = duck_sql(TYPED + DEP, "select * from dep")
ALL_ERR = LINE_ERRORS + DEP + """,
every_error as (select filing_id, 0 as fase, line_no, tipo, ordem, mensagem from line_err union all select filing_id, 1, line_no, tipo, 0, mensagem from dep)"""
ORACLE["filing_verdict"] = duck_sql(ALL_ERR, """select t.filing_id, t.n as total_linhas, coalesce(e.n, 0) as n_erros, coalesce(e.n, 0) = 0 as valido
  from (select filing_id, count(*) as n from lines group by all) t left join (select filing_id, count(*) as n from every_error group by all) e on t.filing_id = e.filing_id""")
ORACLE["top_messages"] = duck_sql(ALL_ERR, """select filing_id, cast(rn as int) as posicao, concat('Linha ', cast(line_no as string), case when tipo <> '' then concat(' (', tipo, ')') else '' end, ': ', mensagem) as mensagem,
  greatest(tot - 3, 0) as adicionais from (select *, row_number() over (partition by filing_id order by fase, line_no, ordem, mensagem) as rn, count(*) over (partition by filing_id) as tot from every_error) where rn <= 3""")
ORACLE["fix_lines"] = duck_sql(LINES + """,
f0 as (select *, substr(value,1,2) as t, case substr(value,1,2) when 'EM' then 31 when 'TN' then 276 when 'CC' then 103 when 'TI' then 109 when 'PI' then 145 when 'LA' then 86 end as w,
  substr(value,1,2) = 'CC' and length(value) = 104 and substr(value,102,1) = ' ' and substr(value,103,2) in ('RO','AQ','FE','AE') as sh from lines),
f1 as (select *, case when sh then concat(substr(value,1,101), substr(value,103,2))
  when t = 'TN' and length(value) >= 276 then concat(substr(value,1,274), case when substr(value,275,1) in ('P','A') then substr(value,275,1) else 'P' end,
     case when substr(value,276,1) in ('P','A') then substr(value,276,1) else 'P' end, substr(value,277)) else value end as v from f0),
f2 as (select *, case when length(v) > w and trim(substr(v, w + 1)) <> '' then concat('(', t, ') excede tamanho esperado (', cast(length(v) as string), ' > ', cast(w as string), ') com dados deslocados.') end as erro from f1),
f3 as (select *, case when w is null or erro is not null then v else rpad(v, w, ' ') end as v2 from f2)""",
    """select filing_id, line_no, erro, case when sh then 'ajuste automatico aplicado em CC (modal deslocado).' end as aviso,
  case when t = 'CC' and erro is null and substr(v2,102,2) not in ('RO','AQ','FE','AE') then concat(substr(v2,1,101), 'RO') else v2 end as value from f3""")

# --- learning ----------------------------------------------------------------------------


def _fingerprint(source):
    piece = lambda i: f"cast(sum(cast(concat('0x', substr(d, {1 + 7 * i}, 7)) as bigint)) as string)"
    return (f"select filing_id, sha256(concat_ws('|', cast(count(*) as string), {', '.join(piece(i) for i in range(9))})) as arquivo_sha256 "
            f"from (select filing_id, sha256(concat(cast(line_no as string), ':', value)) as d from {source}) group by filing_id")


ORACLE["content_fingerprint"] = duck_sql(LINES, _fingerprint("lines"))
ORACLE["replay_filter"] = duck_sql(LINES + f""",
more as (select filing_id, line_no, value from lines union all select concat(filing_id, '-COPIA'), line_no, value from lines where filing_id like '%-03'),
files as ({_fingerprint('more')}), past_lines as (select * from lines where filing_id like '%-05'),
past as (select max(cast(substr(filing_id,2,2) as bigint)) as id, arquivo_sha256 from ({_fingerprint('past_lines')}) group by arquivo_sha256)""",
    """select f.filing_id, p.id is not null or f.filing_id <> min(f.filing_id) over (partition by f.arquivo_sha256) as replay, p.id as sessao_referencia
  from files f left join past p on f.arquivo_sha256 = p.arquivo_sha256""")

LEARN = TYPED + ", tn as (" + _parse("TN") + "), seen as (" + " union all ".join(
    f"select filing_id, line_no, case when nf_numero = '' then 'N/A' else nf_numero end as nf, '{p}' as campo, {p}_nome as nome, {p}_cnpj as documento, {key(p + '_nome')} as k0 from tn" for p in PARTIES) + f"""),
seen1 as (select *, case when k0 in ('NAO INFORMADO','SEM NOME','N/A','NA','NONE','NULL') then '' else k0 end as nome_key, {cnpj_ok('documento')} or {cpf_ok('documento')} as okd from seen),
seen2 as (select *, length(nome_key) >= 5 and okd as aceito, cast(right(filing_id, 2) as int) % 2 as odd from seen1)"""


def _cands(name, where):
    return (f", {name} as (select nome_key, documento, campo, case when length(documento)=11 then 'CPF' else 'CNPJ' end as tipo_documento, count(*) as ocorrencias, "
            f"arg_min(nome, concat(filing_id, lpad(cast(line_no as string), 12, '0'))) as nome_original, "
            f"substr(string_agg(distinct nf, ',' order by nf), 1, 120) as nf_amostra from seen2 where aceito and {where} group by nome_key, documento, campo)")


def _classify(src, out):
    return (f", {out}_g as (select nome_key, campo, arg_max(documento, ocorrencias) as lider, max(ocorrencias) as top, sum(ocorrencias) as total, count(*) as n, "
            f"coalesce(list_sort(list(ocorrencias), 'DESC')[2], 0) as sec from {src} group by all), "
            f"{out} as (select s.* exclude (status, status_motivo), case when ok and documento = lider then 'ativo' else 'quarentena' end as status, "
            f"case when ok and documento = lider then 'confianca_suficiente' when ok then 'conflito_ou_baixa_confianca' else 'baixa_confianca' end as status_motivo "
            f"from {src} s join (select *, (n = 1 or top >= sec + 2) and top >= 2 and top / total >= case campo when 'destinatario' then 0.70 else 0.65 end as ok from {out}_g) g "
            f"on s.nome_key = g.nome_key and s.campo = g.campo)")


ORACLE["learn_candidates"] = duck_sql(LEARN + _cands("c", "true"), "select * from c")
ORACLE["learn_file_counts"] = duck_sql(LEARN, """select l.filing_id, coalesce(t.n, 0) as total_tn, coalesce(s.c, 0) as candidatos, coalesce(s.i, 0) as ignorados, cast(0 as bigint) as linhas_invalidas
  from (select distinct filing_id from lines) l left join (select filing_id, count(*) as n from tn group by all) t on l.filing_id = t.filing_id
  left join (select filing_id, count(distinct case when aceito then concat(nome_key, '|', documento, '|', campo) end) as c, count(*) filter (where not aceito) as i from seen2 group by all) s on l.filing_id = s.filing_id""")
_M1 = _cands("c1", "odd = 1") + ", m0 as (select *, '' as status, '' as status_motivo from c1)" + _classify("m0", "m1") + _cands("c2", "odd = 0")
_M2 = LEARN + _M1 + """,
u as (select coalesce(a.nome_key, b.nome_key) as nome_key, coalesce(a.documento, b.documento) as documento, coalesce(a.campo, b.campo) as campo,
  coalesce(b.nome_original, a.nome_original) as nome_original, coalesce(b.tipo_documento, a.tipo_documento) as tipo_documento,
  coalesce(a.ocorrencias, 0) + coalesce(b.ocorrencias, 0) as ocorrencias, case when b.documento is not null then 'lote2' else 'lote1' end as origem_arquivo, '' as status, '' as status_motivo
  from m1 a full join c2 b on a.nome_key = b.nome_key and a.documento = b.documento and a.campo = b.campo)""" + _classify("u", "m2") + """,
items as (select c.*, s.ocorrencias as ocorrencias_total, s.status as fim, o.status as ini,
  concat(case when o.status is null then 'NOVO' else 'ATUALIZADO' end, '_', case when coalesce(o.status,'') <> 'ativo' and s.status = 'ativo' then 'PROMOVIDO'
     when o.status = 'ativo' and s.status <> 'ativo' then 'REBAIXADO' when s.status = 'ativo' then 'ATIVO' else 'QUARENTENA' end) as acao
  from c2 c join m2 s on c.nome_key = s.nome_key and c.documento = s.documento and c.campo = s.campo
  left join m1 o on c.nome_key = o.nome_key and c.documento = o.documento and c.campo = o.campo)"""
ORACLE["learn_session"] = duck_sql(_M2, "select campo, nome_original, nome_key, documento, tipo_documento, acao, ocorrencias as ocorrencias_arquivo, ocorrencias_total, nf_amostra from items")
ORACLE["learn_snapshot"] = duck_sql(_M2, "select nome_key, nome_original, documento, tipo_documento, campo, ocorrencias, status, status_motivo, origem_arquivo from m2")
ORACLE["learn_report"] = duck_sql(_M2, """select count(*) as candidatos, count(*) filter (where acao like 'NOVO%') as aprendidos_novos, count(*) filter (where acao like 'ATUALIZADO%') as atualizados,
  count(*) filter (where acao like '%PROMOVIDO') as promovidos, count(*) filter (where acao like '%REBAIXADO') as rebaixados,
  count(*) filter (where fim = 'ativo') as ativos_sessao, count(*) filter (where fim <> 'ativo') as quarentena_sessao from items""")
ORACLE["learn_details"] = duck_sql(_M2, """select concat('[', acao, '] ', campo, ': ''', nome_original, ''' -> ', documento, ' (+', cast(ocorrencias as string), ', total=', cast(ocorrencias_total as string),
  ', status=', fim, ', NF=', nf_amostra, ')') as detalhe from items order by campo, nome_original, documento limit 40""")
ORACLE["classify_pairs"] = duck_sql(COMPANY + "," + PAIRS + _classify("pairs", "cl"), "select nome_key, documento, campo, ocorrencias, status, status_motivo from cl")
ORACLE["memory_summary"] = duck_sql(COMPANY + _DIMS, """select count(*) as total_pares, count(distinct nome_key) as total_nomes, count(distinct documento) as total_documentos,
  count(*) filter (where status = 'ativo') as pares_ativos, count(*) filter (where status = 'quarentena') as pares_quarentena,
  (select count(*) from registry) + count(distinct documento) as total_registros from pairs""")

# --- extraction: the reports were written from known values, so those are the answer ----------

# The ids in the order they are read: issuer, contracting party, recipient where all three are masked.
# A bare contracting id comes after the masked recipient, and only if nobody else has it.
ORACLE["extract_from_text"] = duck_sql(REPORTS + """,
roles as (select *, h % 5 <> 0 as masked_c, not abroad as masked_d, cdoc <> edoc and (abroad or cdoc <> ddoc) as new_c
  from report_base where h % 9 <> 4),
placed2 as (select *, case when masked_c then cdoc when masked_d then ddoc when new_c then cdoc end as second,
  case when masked_c and masked_d then ddoc when not masked_c and masked_d and new_c then cdoc end as third from roles)""",
    """select filing_id, nf as nf_numero, dmy as nf_data, cte as cte_numero, dmy as cte_data, edoc as emitente_cnpj, enome as emitente_nome,
  coalesce(second, edoc) as contratante_cnpj, case when h % 6 = 1 then enome else cnome end as contratante_nome,
  third as destinatario_cnpj, dnome as destinatario_nome, abroad as destinatario_exterior, dnome as recebedor from placed2""")
ORACLE["extract_from_cells"] = duck_sql(CELLS, f"""
select * from (
  select filing_id, (page_no * 3 + 1) * 4 + r as seq,
    case when r = 2 then nf when h % 2 = 0 or h % 9 <> 1 then cast(cast(nf as bigint) + 1 as string) end as nf_numero,
    case when r = 2 and h % 8 = 5 then null else dmy end as nf_data,
    cte as cte_numero, dmy as cte_data, dmy as data_entrega, edoc as emitente_cnpj, enome as emitente_nome,
    case when h % 4 in (1, 2) then edoc else cdoc end as contratante_cnpj, case when h % 4 in (1, 2) then enome else cnome end as contratante_nome,
    case when abroad then null when h % 7 = 1 and length(ddoc) = 11 then null
         when h % 7 = 1 and substr(ddoc, 12, 2) in ('14','15','16','17','18','19') then ddoc else ddoc end as destinatario_cnpj,
    dnome as destinatario_nome, abroad as destinatario_exterior, case when h % 3 = 2 then 'JOSE LIMA' else dnome end as recebedor
  from report_base, unnest([2, 3]) as s(r) where r = 3 or h % 8 <> 5) where nf_numero is not null""")
# Pages with a table record, then the text (the last table of its page) of pages without one.
ORACLE["extract_records"] = duck_sql(CELLS, """
select t.filing_id, t.seq, t.nf_numero, t.cte_numero, t.emitente_cnpj, t.destinatario_exterior from (
  select filing_id, page_no, (page_no * 1028 + case when page_no % 3 = 1 then 255 else 1026 end) * 4 + r as seq,
    case when r = 2 then nf when h % 2 = 0 or h % 9 <> 1 then cast(cast(nf as bigint) + 1 as string) end as nf_numero,
    cte as cte_numero, edoc as emitente_cnpj, abroad as destinatario_exterior
  from report_base, unnest([2, 3]) as s(r) where (r = 3 or h % 8 <> 5) and page_no % 3 <> 0) t where nf_numero is not null
union all
select b.filing_id, (b.page_no * 1028 + 1027) * 4 + 1, b.nf, b.cte, b.edoc, b.abroad from report_base b
where h % 9 <> 4 and (page_no % 3 = 0 or not ((h % 8 <> 5) or h % 2 = 0 or h % 9 <> 1))""")
ORACLE["layout_check"] = duck_sql(REPORTS + """,
first_pages as (select filing_id, arg_min(text, page_no) as t from report_pages group by filing_id),
marks as (select filing_id, concat_ws(',', case when not regexp_matches(t, '(?i)EMITENTE') then 'EMITENTE' end, case when not regexp_matches(t, '(?i)DESTINAT[ÁAá]RIO') then 'DESTINATARIO' end,
  case when not regexp_matches(t, '(?i)CONTRATANTE|CONTRANTE|CONTRANE|CONTRATE') then 'CONTRATANTE' end, case when not regexp_matches(t, '(?i)CT-?E|N[º°]\\s*CT') then 'CTE' end,
  case when not regexp_matches(t, '(?i)CNPJ[/\\s]?CPF|CPF[/\\s]?CNPJ|DOCUMENTO') then 'CNPJ_CPF' end) as faltando from first_pages)""",
    "select filing_id, faltando, faltando = '' as valido from marks")

# Damaged ids: undo the letters, then try every way to drop the surplus digit of a group.
ORACLE["repair_ocr_documents"] = duck_sql(DAMAGED + f""",
bad as (select distinct text, regexp_replace(regexp_replace(translate(upper(text), 'OQDIL|!ZSBGT', '000111125867'), '[^0-9./-]', ' ', 'g'), '(\\d+) +(\\.\\d)', '\\1\\2', 'g') as t from damaged where text like 'CNPJ %'),
tok as (select text, regexp_extract(t, '(\\d{{2,8}})\\.(\\d{{3,8}})\\.(\\d{{3,8}})/(\\d{{4,8}})-(\\d{{2,8}})', ['a','b','c','d','e']) as g from bad
  where regexp_matches(t, '\\d{{2,8}}\\.\\d{{3,8}}\\.\\d{{3,8}}/\\d{{4,8}}-\\d{{2,8}}')),
cand as (select text, concat(g.a, case when length(g.b) = 3 then g.b else concat(substr(g.b,1,i-1), substr(g.b,i+1)) end, g.c, g.d,
  case when length(g.e) = 2 then g.e else concat(substr(g.e,1,j-1), substr(g.e,j+1)) end) as doc from tok, unnest([1,2,3,4]) as s(i), unnest([1,2,3]) as u(j)),
good as (select distinct text, doc from cand where {cnpj_ok('doc')})""",
    "select text, min(doc) as doc from good group by text having count(*) = 1")

# --- reports -----------------------------------------------------------------------------


def _kind(field):
    def cond(k):
        return " and ".join("(" + " or ".join(f"contains(txt, '{w}')" for w in words.split("|")) + ")" for words in k.words)
    value = {"tipo": lambda k: q(k.tipo), "acao": lambda k: q(k.acao), "manual": lambda k: "true" if k.manual else "false"}[field]
    return "case " + " ".join(f"when {cond(k)} then {value(k)}" for k in KINDS) + f" else {value(OTHER)} end"


ADJ = ALERTS + AUDIT + f""",
adj as (
  select filing_id, nf, tipo, mensagem, seq * 16 + ordem as chegada from audit where conta_ajuste
  union all select filing_id, nf, tipo, mensagem, 4611686018427387904 + seq * 16 + ordem from alerts),
adj1 as (select *, case when nf in ('', 'N/A', 'NA') then null else nf end as nf1 from adj),
adj2 as (select *, regexp_replace(case when starts_with(mensagem, concat('NF ', coalesce(nf1, ''), ':')) then trim(substr(mensagem, length(coalesce(nf1, '')) + 5)) else mensagem end, '^AVISO:\\s*', '') as aviso from adj1),
adj3 as (select *, trim(regexp_replace(aviso, '\\s+', ' ', 'g')) as detalhe from adj2),
adj4 as (select *, translate(lower(detalhe), '{ACCENTED}', '{PLAIN}') as txt from adj3),
cls0 as (select filing_id, nf1 as nf, chegada, aviso, detalhe, tipo as tipo0, {_kind('tipo')} as k, {_kind('acao')} as acao, {_kind('manual')} as manual from adj4),
cls as (select * exclude (tipo0, k), case when k = 'REVISAO' and nf is not null then trim(replace(tipo0, '_', ' ')) else k end as tipo from cls0),
issues as (select filing_id, nf, tipo, detalhe, acao, min(chegada) as c from cls where manual and nf is not null group by all)"""
ORACLE["analyst_issues"] = duck_sql(ADJ, "select filing_id, nf, tipo, detalhe, acao, row_number() over (partition by filing_id, nf order by c) as posicao from issues")
ORACLE["analyst_summary"] = duck_sql(ADJ + ", acts as (select filing_id, nf, acao, min(c) as c from issues group by all), acts2 as (select filing_id, nf, string_agg(acao, ' | ' order by c) as acoes from acts group by all)",
    """select i.filing_id, i.nf, count(*) as n_pendencias, arg_min(concat('[', tipo, '] ', detalhe), c) as primeira, any_value(acoes) as acoes
  from issues i join acts2 a on i.filing_id = a.filing_id and i.nf = a.nf group by i.filing_id, i.nf""")
ORACLE["operational_alerts"] = duck_sql(ADJ + """,
ops as (select * from cls where not manual), samp as (select filing_id, tipo, detalhe, min(chegada) as c from ops where detalhe <> '' group by all),
samp2 as (select *, row_number() over (partition by filing_id, tipo order by c) as rn from samp),
samp3 as (select filing_id, tipo, string_agg(detalhe, chr(10) order by rn) as amostras from samp2 where rn <= 3 group by all)""",
    """select o.filing_id, o.tipo, count(distinct nf) as n_nfs, any_value(amostras) as amostras from ops o left join samp3 s on o.filing_id = s.filing_id and o.tipo = s.tipo group by o.filing_id, o.tipo""")
ORACLE["general_notices"] = duck_sql(ADJ, "select distinct filing_id, aviso from cls where manual and nf is null and aviso <> ''")
ORACLE["final_status"] = duck_sql(STATS_CTES + ADJ.replace(PREP, "", 1).replace(AUDIT, "", 1) + """,
opn as (select filing_id, count(distinct nf) as n from issues group by all),
fin as (select s.*, greatest(total_ajustes_manuais, coalesce(o.n, 0)) as aj from stats s left join opn o on s.filing_id = o.filing_id)""",
    """select filing_id, case when total_com_erros_criticos > 0 then 'FALHA (Erros criticos)' when aj > 0 or total_com_erros > 0 then 'SUCESSO (Com ressalvas)' else 'SUCESSO' end as status,
  total_aprovados, total_corrigidos, aj as total_ajustes, total_com_erros_criticos from fin""")
LOGS = LOG + """,
l0 as (select ordem, upper(trim(coalesce(tipo, 'INFO'))) as tipo, trim(mensagem) as mensagem, upper(nullif(regexp_extract(mensagem, '(?i)\\bNF\\s+([A-Z0-9.-]+)\\b', 1), '')) as nf from log_events where trim(mensagem) <> ''),
l1 as (select ordem, coalesce(nf, '-') as id_linha, case when nf is null then 'Sistema' else concat('NF ', nf) end as cliente, case when nf is null then 'sistema' else concat(lower(tipo), ':', nf) end as identificador,
  0 as numero_pagina, 0 as numero_linha, case when tipo in ('ERRO','CRITICO','ALERTA','ACAO_NECESSARIA') then 'Erro' when tipo in ('SUCESSO','CHECK') then 'Sucesso'
    when nf is not null and tipo in ('ATENCAO','AVISO') then 'Erro' else 'Processando' end as status, mensagem,
  nf is not null and tipo in ('ERRO','CRITICO','ALERTA','ACAO_NECESSARIA') as pode_reprocessar from l0),
cons as (select * exclude (rn) from (select *, row_number() over (partition by id_linha, identificador order by ordem desc) as rn from l1) where rn = 1 or cliente = 'Sistema')"""
ORACLE["log_consolidation"] = duck_sql(LOGS, "select * from cons")
ORACLE["log_totals"] = duck_sql(LOGS, "select count(*) as total_logs, count(*) filter (where pode_reprocessar) as total_reprocessaveis from cons")

# --- branches and periods ----------------------------------------------------------------

ORACLE["attach_branch"] = duck_sql(FREIGHT + "," + FILINGS + "," + BRANCHES, """select f.filing_id, b.nome as filial_nome, b.nome is not null as filial_existe,
  case when b.nome is not null then concat(b.nome, ' - ', f.cnpj) end as filial_rotulo from filings f left join branches b on f.cnpj = b.cnpj""")
ORACLE["resolve_branch"] = duck_sql(COMPANY + "," + BRANCHES + "," + REQUESTS + f""",
req as (select id, trim(valor) as v, case when contains(valor, ' - ') then {digits("split_part(valor, ' - ', -1)")} when length({digits('valor')}) = 14 then {digits('valor')} end as direct from requests),
found as (select id, min(b.cnpj) as cnpj from req join branches b on contains(lower(b.nome), lower(v)) where direct is null group by id having count(*) = 1)""",
    "select r.id, case when length(coalesce(direct, cnpj)) = 14 then coalesce(direct, cnpj) end as cnpj from req r left join found f on r.id = f.id")
ORACLE["default_periods"] = """select o_orderkey, cast(case when month(o_orderdate) <= 6 then 12 else month(o_orderdate) end as int) as mes,
  cast(year(o_orderdate) - case when month(o_orderdate) <= 6 then 1 else 0 end as int) as ano from orders"""

# --- files, stores, registries -----------------------------------------------------------

# Files that write_odd_files() leaves: two lines a row; where CR or LF ends the first, the parser sees two as well.
ODD = LINES + """,
marked as (select filing_id, line_no, right(filing_id, 2) as mm, concat(case when right(filing_id, 2) = '06' and line_no = 1 then chr(65279) else '' end, value) as v,
  case when right(filing_id, 2) = '04' then chr(13) || chr(10) else [chr(10), chr(13) || chr(10), chr(13), chr(11), chr(12), chr(28), chr(29), chr(30),
    chr(133), chr(8232), chr(8233)][line_no % 11 + 1] end as fim, strlen(value) = length(value) as ascii from lines),
files as (select filing_id, bool_and(ascii) or any_value(mm) <> '04' as utf8, any_value(mm) = '06' as bom, 2 * count(*) as linhas from marked group by filing_id),
text_lines as (select m.filing_id, 2 * line_no - 1 as line_no, v as value from marked m union all select filing_id, 2 * line_no, 'X' from marked),
newline_parts as (
  select filing_id, line_no, 0 as sub, case when fim in (chr(10), chr(13), chr(13) || chr(10)) then v else concat(v, fim, 'X') end as value from marked
  union all select filing_id, line_no, 1, 'X' from marked where fim in (chr(10), chr(13), chr(13) || chr(10)))"""
ORACLE["read_files"] = duck_sql(ODD, "select t.filing_id, t.line_no, t.value from text_lines t join files using (filing_id) where utf8")
ORACLE["read_files_legacy"] = duck_sql(
    ODD, "select filing_id, row_number() over (partition by filing_id order by line_no, sub) as line_no, value from newline_parts")
ORACLE["file_checks"] = duck_sql(ODD, "select filing_id, cast(linhas as bigint) as linhas, utf8, true as legivel, bom from files")
ORACLE["file_problems"] = duck_sql(ODD, """select filing_id, cast(1 as bigint) as line_no, 'EM' as tipo,
  'arquivo possui BOM UTF-8; isso desloca o layout posicional da primeira linha.' as mensagem from files where bom
  union all select filing_id, 1, 'EM', 'Arquivo nao esta em UTF-8 valido.' from files where not utf8""")
_ODD_LINES = ODD + ", good as (select t.* from text_lines t join files using (filing_id) where utf8)"
_AS_GOOD = _ODD_LINES + (LINE_ERRORS + DEP)[len(LINES):].replace(" from lines)", " from good)", 1) + """,
every_error as (select filing_id, 0 as fase, line_no, tipo, ordem, mensagem from line_err union all select filing_id, 1, line_no, tipo, 0, mensagem from dep
  union all select filing_id, 2, 1, 'EM', 0, 'o BOM nao e imprimivel' from good where line_no = 1 and starts_with(value, chr(65279)) and not regexp_matches(value, '[\\x00-\\x1f\\x7f]')
  union all select filing_id, 2, 1, 'EM', 0, 'bom' from files where bom union all select filing_id, 2, 1, 'EM', 0, 'utf8' from files where not utf8)"""
ORACLE["checked_files"] = duck_sql(_AS_GOOD, """select f.filing_id, coalesce(t.n, 0) as total_linhas, coalesce(e.n, 0) as n_erros, coalesce(e.n, 0) = 0 as valido
  from files f left join (select filing_id, count(*) as n from good group by all) t on f.filing_id = t.filing_id
  left join (select filing_id, count(*) as n from every_error group by all) e on f.filing_id = e.filing_id""")

WRITTEN = LINES + """,
rewritten as (select filing_id, row_number() over (partition by filing_id order by line_no) as line_no, concat(value, ' V2') as value
  from lines where cast(right(filing_id, 2) as int) % 2 = 1 and line_no % 2 = 1
  union all select filing_id, line_no, value from lines where cast(right(filing_id, 2) as int) % 2 = 0),
written as (select filing_id, line_no, regexp_replace(value, '[\\x00-\\x1f\\x7f]', '', 'g') as value from rewritten)"""
ORACLE["written_filings"] = duck_sql(WRITTEN, "select * from written")
ORACLE["file_fingerprint"] = duck_sql(WRITTEN, """select filing_id as arquivo, cast(sum(strlen(value) + 1) as bigint) as tamanho,
  sha256(string_agg(concat(value, chr(10)), '' order by line_no)) as arquivo_sha256 from written group by filing_id""")

ORACLE["memory_store"] = duck_sql(_M2, "select nome_key, nome_original, documento, tipo_documento, campo, ocorrencias, status, status_motivo, origem_arquivo from m2")
ORACLE["memory_items"] = duck_sql(_M2, """select campo, nome_key, documento, tipo_documento, acao, ocorrencias as ocorrencias_arquivo, ocorrencias_total, fim as status_final,
  cast(2 as bigint) as session_id from items union all
  select c.campo, c.nome_key, c.documento, c.tipo_documento, concat('NOVO_', case when m.status = 'ativo' then 'PROMOVIDO' else 'QUARENTENA' end), c.ocorrencias, c.ocorrencias, m.status, 1
  from c1 c join m1 m on c.nome_key = m.nome_key and c.documento = m.documento and c.campo = m.campo""")
ORACLE["memory_sessions"] = duck_sql(LEARN + f", prints as ({_fingerprint('lines')})", """select case when cast(right(l.filing_id, 2) as int) % 2 = 1 then 1 else 2 end::bigint as id,
  l.filing_id as arquivo_txt, p.arquivo_sha256, coalesce(t.n, 0) as total_tn, coalesce(s.c, 0) as candidatos, coalesce(s.i, 0) as ignorados
  from (select distinct filing_id from lines) l join prints p on l.filing_id = p.filing_id left join (select filing_id, count(*) as n from tn group by all) t on l.filing_id = t.filing_id
  left join (select filing_id, count(distinct case when aceito then concat(nome_key, '|', documento, '|', campo) end) as c, count(*) filter (where not aceito) as i from seen2 group by all) s on l.filing_id = s.filing_id""")
ORACLE["learn_stream"] = duck_sql(LEARN + _cands("c", "true") + ", m0 as (select *, '' as status, '' as status_motivo from c)" + _classify("m0", "m"),
                                  "select nome_key, documento, campo, tipo_documento, ocorrencias, status, status_motivo from m")

HISTORY = FREIGHT + "," + CHANGES + """,
arrived as (select doc, momento, trim(upper(arg_max(nome, ordem))) as nome from changes group by doc, momento),
begun as (select doc, nome, momento from (select *, lag(nome) over (partition by doc order by momento) as antes from arrived) where antes is null or antes <> nome),
history as (select doc, nome, momento as valido_desde, lead(momento) over (partition by doc order by momento) as valido_ate from begun)"""
ORACLE["registry_history"] = duck_sql(HISTORY, "select * from history")
ORACLE["registry_lookup"] = duck_sql(HISTORY + "," + QUESTIONS, f"""select q.pedido, q.seq, q.doc, q.momento, h.nome from questions q left join history h
  on {digits('q.doc')} = h.doc and h.valido_desde <= q.momento and (h.valido_ate is null or h.valido_ate > q.momento)""")
UPSERT = HISTORY + "," + REGISTRY
ORACLE["registry_upsert"] = duck_sql(UPSERT + ", incoming as (select doc, trim(upper(concat(nome, ' nova'))) as novo from registry)", """
  select h.doc, h.nome, h.valido_desde, case when h.valido_ate is null and i.novo <> h.nome then 20300101 else h.valido_ate end as valido_ate
  from history h left join incoming i on h.doc = i.doc
  union all select i.doc, i.novo, 20300101, null from incoming i left join history h on h.doc = i.doc and h.valido_ate is null where h.doc is null or h.nome <> i.novo""")
ORACLE["registry_then"] = duck_sql(HISTORY, "select doc, nome from history where valido_desde <= 20170101 and (valido_ate is null or valido_ate > 20170101)")

ORACLE["invoice_positions"] = duck_sql(FREIGHT, """select filing_id, seq, nf_numero, row_number() over (order by
  case when regexp_matches(nf_numero, '^[0-9]+$') then cast(nf_numero as hugeint) end nulls last, nf_numero nulls last, filing_id, seq) as posicao from freight""")
GAPS = LINES + ", gaps as (select filing_id, line_no, case when line_no % 97 <> 5 then value end as value from lines)" + TYPED[len(LINES):].replace(" from lines)", " from gaps)")


def _joined(tipo):
    names = ", ".join(f.name for f in LAYOUT[tipo])
    return f"select filing_id, line_no, '{tipo.lower()}' as saida, concat_ws('|', {names}) as campos from ({_parse(tipo)})"


ORACLE["route_lines"] = duck_sql(GAPS, " union all ".join(_joined(t) for t in ("TN", "CC", "TI", "PI")) +
                                 " union all select filing_id, line_no, 'invalid', 'linha ilegivel' from gaps where value is null")
ORACLE["route_counts"] = duck_sql(GAPS, """select s.saida, count(t.saida) as n from (select unnest(['tn', 'cc', 'ti', 'pi', 'invalid', 'ignorada']) as saida) s
  left join (select case when value is null then 'invalid' when tipo in ('TN', 'CC', 'TI', 'PI') then lower(tipo) else 'ignorada' end as saida from typed) t on s.saida = t.saida group by s.saida""")
ORACLE["forbidden_characters"] = duck_sql(LINES + """, found as (
  select distinct filing_id, line_no, unnest(regexp_extract_all(value, '[^\\x00-\\x7f]')) as caractere from lines)""",
    "select filing_id, caractere, count(*) as n_linhas from found group by all")
ORACLE["layout_messages"] = duck_sql(ALL_ERR, """select filing_id, fase, line_no, concat('Linha ', cast(line_no as string),
  case when tipo <> '' then concat(' (', tipo, ')') else '' end, ': ', mensagem) as mensagem from every_error""")
ORACLE["learn_invoices"] = duck_sql(LEARN, "select nome_key, documento, campo, nf, count(*) as n from seen2 where aceito group by all")
ORACLE["alert_samples"] = duck_sql(ADJ, "select filing_id, tipo, detalhe, count(*) as n from cls where not manual and detalhe <> '' group by all")
ORACLE["search_branches"] = duck_sql(COMPANY + "," + TERMS, """select distinct termo, doc as cnpj, nome from terms join company on contains(lower(nome), lower(termo)) where termo <> ''""")
ORACLE["list_branches"] = duck_sql(COMPANY + "," + BRANCHES, "select cnpj, nome, concat(nome, ' - ', cnpj) as rotulo from branches")
ORACLE["loose_documents"] = duck_sql(PARTY_ROWS, """select distinct doc, left(lpad(doc, cast(greatest(length(doc), 14) as int), '0'), 14) as solto
  from (select coalesce(doc, '') as doc from party_rows) where length(doc) not in (11, 14)""")
