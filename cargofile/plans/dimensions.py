"""Small derived tables: registry, learned pairs, resolutions, branches, requests, log events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cargofile.plans.fixtures import COMPANY, FREIGHT, run_sql

# Every third company is in the registry.
REGISTRY = "registry as (select doc, nome from company where k % 3 = 0)"

# Learned pairs: one row per company and field by key, plus a competing id for every fourth name.
PAIRS = """
pair_base as (
  select k, doc, nome, replace(replace(translate(nome, 'ÚÍÉÃÓÊ', 'UIEAOE'), ' & ', ' '), '/', ' ') as nome_key,
         case k % 3 when 0 then 'emitente' when 1 then 'contratante' else 'destinatario' end as campo
  from company),
pairs as (
  select nome_key, nome as nome_original, doc as documento, 'CNPJ' as tipo_documento, campo,
         cast(1 + k % 6 as bigint) as ocorrencias, case when k % 5 = 4 then 'quarentena' else 'ativo' end as status,
         'fixture' as status_motivo, 'a.txt' as origem_arquivo, '2020' as primeira_ocorrencia, '2020' as ultima_ocorrencia
  from pair_base
  union all
  select a.nome_key, lower(a.nome) as nome_original, b.doc as documento, 'CNPJ' as tipo_documento, a.campo,
         cast(1 + a.k % 3 as bigint) as ocorrencias, 'ativo' as status,
         'fixture' as status_motivo, 'b.txt' as origem_arquivo, '2020' as primeira_ocorrencia, '2020' as ultima_ocorrencia
  from pair_base a join pair_base b on a.k + 1 = b.k
  where a.k % 4 = 0 and b.k % 10 <> 9)"""

# Human answers to missing ids: right ones, unusable ones and some to questions nobody asked.
RESOLUTIONS = """
asked as (
  select concat('F', lpad(cast(nation as string), 2, '0'), '-', yy, '-', mm) as filing_id, h, edoc, cdoc, ddoc, pdoc,
         case when h % 101 = 0 then 'N/A' when h % 97 = 0 then 'A12' else cast(1000 + l_orderkey % 899000 as string) end as nf_numero
  from joined),
resolutions as (
  select filing_id, nf_numero, 'emitente_cnpj' as campo, max(case when h % 4 = 1 then pdoc else edoc end) as documento
  from asked where h % 10 = 1 and h % 3 <> 0 group by filing_id, nf_numero
  union all
  select filing_id, nf_numero, 'contratante_cnpj' as campo, max(case when h % 4 = 1 then '123' else cdoc end) as documento
  from asked where h % 11 = 1 and h % 5 <> 0 group by filing_id, nf_numero
  union all
  select filing_id, nf_numero, 'destinatario_cnpj' as campo, max(ddoc) as documento
  from asked where h % 26 = 1 or h % 500 = 7 group by filing_id, nf_numero)"""

BRANCHES = """
branches as (
  select min(doc) as cnpj, concat('Filial ', n_name) as nome
  from company join {nation} on nation = n_nationkey group by n_name)"""

REQUESTS = """
requests as (
  select k as id, case k % 5 when 0 then concat('Filial X - ', doc) when 1 then concat(' ', substr(doc, 1, 8), '/', substr(doc, 9, 6))
                    when 2 then lower(n_name) when 3 then concat('filial ', n_name) else 'nada' end as valor
  from company join {nation} on nation = n_nationkey)"""

LOG = """
log_events as (
  select event_id as ordem,
         case event_id % 9 when 0 then 'erro' when 1 then 'CRITICO' when 2 then 'ALERTA' when 3 then 'ACAO_NECESSARIA'
              when 4 then 'SUCESSO' when 5 then 'CHECK' when 6 then 'ATENCAO' when 7 then null else 'INFO' end as tipo,
         case when event_id % 11 = 0 then concat('Processando ', event_type)
              else concat('Nf ', cast(user_id as string), ': ', event_type, ' ', cast(event_id % 4 as string)) end as mensagem
  from {events})"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"{COMPANY},{REGISTRY}", "select * from registry")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"{COMPANY},{PAIRS}", "select * from pairs")


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"{FREIGHT},{RESOLUTIONS}", "select * from resolutions")


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"{COMPANY},{BRANCHES}", "select * from branches")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"{COMPANY},{REQUESTS}", "select * from requests")


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, LOG, "select * from log_events")
