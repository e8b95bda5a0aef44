"""Gate on missing ids and human resolutions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cargofile.functions import documents as D, text as X
from cargofile.operators import ordered
from cargofile.operators.validate import pending_documents
from cargofile.schema import PARTIES

KEY = ["filing_id", "nf", "campo"]


def _answers(resolutions: DataFrame) -> DataFrame:
    """One digits-only answer per key; the last one (``ordem``) wins when several are given."""
    order = F.col("ordem") if "ordem" in resolutions.columns else F.lit(0)
    return resolutions.select(
        "filing_id", X.strip(F.col("nf_numero")).alias("nf"), "campo",
        D.digits_only(F.coalesce("documento", F.lit(""))).alias("documento"), order.alias("_o"),
    ).groupBy(*KEY).agg(F.max_by("documento", F.struct("_o", "documento")).alias("documento"))


def resolution_problems(records: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Why a filing cannot go on: answers to nothing, unusable answers, ids still missing."""
    pending = pending_documents(records).select(*KEY, "campo_label", "aceita_cpf").distinct()
    answers = _answers(resolutions)
    doc = F.col("documento")
    ok = F.when(F.col("aceita_cpf"), D.is_valid_for_field("documento", True)).otherwise(D.is_valid_for_field("documento", False))
    matched = pending.join(answers, KEY, "left").withColumn("_ok", ok)
    unknown = answers.join(pending, KEY, "left_anti").select(
        *KEY, F.lit("pendencia_inexistente").alias("problema"),
        F.concat(F.lit("Documento informado para pendencia inexistente: NF "), "nf", F.lit(" ("), "campo", F.lit(").")).alias("mensagem"))
    rest = matched.filter(doc.isNull() | ~F.col("_ok")).select(
        *KEY,
        F.when(doc.isNull(), "documento_faltante").otherwise("documento_invalido").alias("problema"),
        F.when(doc.isNull(), F.concat(F.lit("NF "), "nf", F.lit(" ("), "campo_label", F.lit(")")))
        .otherwise(F.concat(F.lit("NF "), "nf", F.lit(": "), "campo_label", F.lit(" exige "),
                            F.when(F.col("aceita_cpf"), "CPF ou CNPJ valido").otherwise("CNPJ valido"), F.lit(".")))
        .alias("mensagem"))
    return unknown.unionByName(rest)


def apply_resolutions(records: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Records with valid answers written into their pending id columns."""
    doc = F.col("documento")
    hits = (
        pending_documents(records).select("seq", *KEY, "aceita_cpf")
        .join(_answers(resolutions), KEY)
        .filter(F.when(F.col("aceita_cpf"), D.is_valid_for_field("documento", True)).otherwise(D.is_valid_for_field("documento", False)))
        .groupBy("filing_id", "seq")
        .agg(*[F.max(F.when(F.col("campo") == f"{p}_cnpj", doc)).alias(f"_{p}") for p in PARTIES])
    )
    out = records.join(hits, ["filing_id", "seq"], "left")
    return out.withColumns({f"{p}_cnpj": F.coalesce(f"_{p}", f"{p}_cnpj") for p in PARTIES}).drop(*[f"_{p}" for p in PARTIES])


def pending_messages(records: DataFrame, n: int = 5) -> DataFrame:
    """First pendings of every filing in record order and how many more there are."""
    pend = pending_documents(records).withColumn("_f", F.when(F.col("campo") == "emitente_cnpj", 0).when(
        F.col("campo") == "contratante_cnpj", 1).otherwise(2))
    total = pend.groupBy("filing_id").agg(F.count(F.lit(1)).alias("_n"))
    few = ordered.top_n(pend, ["filing_id"], ["seq", "_f"], n, "_p").groupBy("filing_id").agg(
        F.array_sort(F.collect_list(F.struct("_p", "nf", "campo_label"))).alias("_l"))
    text = F.array_join(F.transform("_l", lambda x: F.concat(F.lit("NF "), x["nf"], F.lit(" ("), x["campo_label"], F.lit(")"))), ", ")
    more = F.when(F.col("_n") > n, F.concat(F.lit(", ... +"), (F.col("_n") - n).cast("string"))).otherwise("")
    return few.join(total, "filing_id").select("filing_id", F.col("_n").alias("n_pendencias"), F.concat(text, more).alias("mensagem"))


def require_resolved(problems: DataFrame) -> None:
    """Stop when anything is left to resolve, naming the first few."""
    left = problems.orderBy(*KEY).limit(6).collect()
    if left:
        shown = "; ".join(r.mensagem for r in left[:5]) + ("; ..." if len(left) > 5 else "")
        raise ValueError("required document missing: " + shown)
