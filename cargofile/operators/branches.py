"""Branch dimension: attach, search by name, resolve a typed value."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cargofile.functions import documents as D, text as X
from cargofile.operators.contain import HOT_ROWS, inside

# Characters from which on a term is looked for by its runs of so many.
TERM_GRAM = 3


def _dimension(branches: DataFrame) -> DataFrame:
    return branches.select(D.digits_only(F.col("cnpj")).alias("cnpj"), F.col("nome"))


def attach_branch(filings: DataFrame, branches: DataFrame) -> DataFrame:
    """Filings with branch name, existence flag and "NAME - ID" label.

    No broadcast hint: Spark broadcasts the dimension when its size allows.
    """
    dim = _dimension(branches).withColumnsRenamed({"nome": "filial_nome", "cnpj": "_cnpj"})
    out = filings.join(dim, D.digits_only(F.col("cnpj")) == F.col("_cnpj"), "left").drop("_cnpj")
    return out.withColumns({
        "filial_existe": F.col("filial_nome").isNotNull(),
        "filial_rotulo": F.concat("filial_nome", F.lit(" - "), D.digits_only(F.col("cnpj")))})


def list_branches(branches: DataFrame) -> DataFrame:
    """All branches by name with their label."""
    return _dimension(branches).select("cnpj", "nome", F.concat("nome", F.lit(" - "), "cnpj").alias("rotulo")).orderBy("nome", "cnpj")


def search_branches(terms: DataFrame, branches: DataFrame) -> DataFrame:
    """Branches whose name contains a term, ignoring case: termo, cnpj, nome.

    Terms of three characters and more go by their rarest run of three in the names.  Shorter ones are compared with the
    one or two characters that each name has anywhere, once each.  No term × branch pairs are formed.
    """
    want = terms.select("termo", F.lower("termo").alias("key")).filter(F.col("key") != "").distinct()
    names = _dimension(branches).withColumn("key", F.lower("nome"))
    keys = names.select("key").distinct()
    asked = want.select("key").distinct()
    hits = inside(keys, asked, [], TERM_GRAM)
    short = asked.filter(F.length("key") < TERM_GRAM).withColumnRenamed("key", "piece")
    parts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.array(
        F.substring("key", i, F.lit(1)), F.substring("key", i, F.lit(2))))))
    some = keys.filter(F.length("key") > 0).select("key", F.explode(parts).alias("piece"))
    few = short.limit(HOT_ROWS + 1).count() <= HOT_ROWS
    hits = hits.select("key", "piece").unionByName(some.join(F.broadcast(short) if few else short, "piece").select("key", "piece"))
    return hits.join(names, "key").select(F.col("piece").alias("_term"), "cnpj", "nome").join(
        want.withColumnRenamed("key", "_term"), "_term").select("termo", "cnpj", "nome")


def resolve_branch(requests: DataFrame, branches: DataFrame) -> DataFrame:
    """requests(id, valor) → company id, or null when it cannot be told."""
    text = X.strip(F.coalesce("valor", F.lit("")))
    digits = D.digits_only(text)
    typed = requests.select(
        "id", "valor", text.alias("termo"),
        F.when(text.contains(" - "), D.digits_only(F.substring_index(text, " - ", -1)))
        .when(F.length(digits) == 14, digits).alias("_direct"))
    asked = typed.filter(F.col("_direct").isNull()).select("termo").distinct()
    single = search_branches(asked, branches).groupBy("termo").agg(
        F.min("cnpj").alias("_lo"), F.max("cnpj").alias("_hi")).filter(F.col("_lo") == F.col("_hi")).select(
        "termo", F.col("_lo").alias("_found"))
    cnpj = F.coalesce("_direct", "_found")
    return typed.join(single, "termo", "left").select("id", "valor", F.when(F.length(cnpj) == 14, cnpj).alias("cnpj"))
