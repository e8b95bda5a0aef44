"""SQL (DuckDB dialect) of the queries over files, stores and registries, and the fixtures that both sides share."""

from __future__ import annotations

# Changes of registered names: four spellings of a company's name over the days its freight was shipped.
CHANGES = """
changes as (
  select edoc as doc, case h % 4 when 0 then enome when 1 then lower(enome) when 2 then concat('  ', enome, ' II ') else concat(enome, ' III') end as nome,
         cast(year(l_shipdate) + 20 as bigint) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) as momento, cast(seq as bigint) as ordem
  from joined)"""

# What a company was called some time before goods were shipped; some ids are not registered, some moments lie before the first.
QUESTIONS = """
questions as (
  select cast(l_orderkey as bigint) as pedido, cast(seq as bigint) as seq, case when h % 9 = 1 then concat(substr(cdoc, 1, 13), 'x') else cdoc end as doc,
         cast(year(l_shipdate) + 20 as bigint) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) - h % 5000 as momento
  from joined)"""

TERMS = """
terms as (
  select distinct case k % 7 when 0 then lower(substr(nome, 3, 2 + k % 9)) when 1 then substr(nome, 1, 1) when 2 then substr(nome, 2, 2)
    when 3 then nome when 4 then concat(lpad(cast(k as string), 5, '0'), ' ') when 5 then 'zz top' else substr(nome, 4 + k % 5, 12) end as termo
  from company)"""
