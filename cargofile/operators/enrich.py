"""Filling missing names and ids from the batch, a registry and the learned memory.

J1–J8 and A2.  Records with something missing are turned into long form (one row per
record and party), reduced to distinct questions, answered with joins and aggregates, and
joined back once on the record key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cargofile.functions import documents as D, text as X
from cargofile.operators import ordered
from cargofile.operators.contain import contained, inside
from cargofile.schema import PARTIES
from cargofile.sources.shared import kept, shuffled, unfolded, where

# Key lengths and confidence limits of the lookups.
MIN_KEY = 8            # batch and registry lookups
MIN_CONTAINED = 12     # containment: query key (batch), shorter key (registry)
MIN_MEMORY_KEY = 5
MARGIN = 2
MIN_COUNT = 2
MIN_RATIO = {"emitente": 0.65, "contratante": 0.65, "destinatario": 0.70}


def party_rows(records: DataFrame, *extra: str) -> DataFrame:
    """Long form: filing_id, seq, campo, doc (digits or null), nome (cleaned), nome_key."""
    parts = F.array(*[
        F.struct(F.lit(p).alias("campo"), D.document(F.col(f"{p}_cnpj")).alias("doc"),
                 X.clean(F.col(f"{p}_nome")).alias("nome"))
        for p in PARTIES
    ])
    return (
        unfolded(records, ["filing_id", "seq", *extra], parts, "p")
        .select("filing_id", "seq", *extra, "p.campo", "p.doc", "p.nome")
        .withColumn("nome_key", X.clean_name_key(F.col("nome")))
    )


# --- A2 ----------------------------------------------------------------------------------

def batch_name_index(records: DataFrame) -> DataFrame:
    """Ids seen next to every name key of a filing, per party field (A2)."""
    return (
        where(party_rows(records).filter((F.length("doc") == 14) & (F.col("doc") != D.ZERO_DOC)),
              F.length("nome_key") >= MIN_KEY, "filing_id", "campo", "nome_key", "doc")
        .groupBy("filing_id", "campo", "nome_key", "doc").agg(F.count(F.lit(1)).alias("n"))
    )


def unique_doc(rows: DataFrame, keys: list[str], doc: str = "doc") -> DataFrame:
    """Keys with their single distinct id (null where several compete)."""
    return rows.groupBy(*keys).agg(F.min(doc).alias("_lo"), F.max(doc).alias("_hi")).select(
        *keys, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias(doc))


# --- J3 / J4 containment -----------------------------------------------------------------

def containment_candidates(queries: DataFrame, index: DataFrame, by: list[str], gram: int) -> DataFrame:
    """(by…, key, doc) candidates where one key contains the other, either way round.

    ``queries`` has distinct (by…, key); ``index`` has (by…, key, doc).  Only the smallest
    and largest id per key survive, which is enough to decide "exactly one distinct id".
    Both keys must have at least ``gram`` characters to take part.
    """
    # Both are narrow and looked at several times; what they come from is not.
    queries = kept(queries.filter(F.length("key") >= gram).select(*by, "key"))
    span = kept(index.filter(F.length("key") >= gram).groupBy(*by, "key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")))

    # index key inside query key
    inner = inside(queries, span, by, gram).select(*by, "key", "lo", "hi")
    # query key inside index key; ids are brought together per piece before anything is looked up
    pieces, _ = contained(span.select(*by, "key"), queries, by, gram)
    outer = (
        pieces.join(shuffled(span), by + ["key"])
        .groupBy(*by, F.col("piece").alias("key")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .join(shuffled(queries), by + ["key"], "left_semi")
    )
    return inner.unionByName(outer).groupBy(*by, "key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


# --- W3, J1, J5 --------------------------------------------------------------------------

def ranked(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Leader, its count, the runner-up's count, total and size of every candidate group.

    The top two rows are cut per map task before the shuffle and the totals are partial
    sums, so a hot group never gathers in one task.
    """
    two = ordered.top_n(rows, keys, [F.desc("ocorrencias"), F.col(value)], 2, "_pos").groupBy(*keys).agg(
        F.max(F.when(F.col("_pos") == 1, F.col("ocorrencias"))).alias("top"),
        F.coalesce(F.max(F.when(F.col("_pos") == 2, F.col("ocorrencias"))), F.lit(0)).alias("segundo"),
        F.max(F.when(F.col("_pos") == 1, F.col(value))).alias(value))
    sums = rows.groupBy(*keys).agg(F.sum("ocorrencias").alias("total"), F.count(F.lit(1)).alias("n"))
    return two.join(sums, keys)


def by_margin() -> Column:
    return (F.col("n") == 1) | (F.col("top") >= F.col("segundo") + MARGIN)


def confident(campo: Column) -> Column:
    """Rule that lets the leading id of a (name, field) group win."""
    ratio = F.coalesce(*[F.when(campo == p, F.lit(r)) for p, r in MIN_RATIO.items()])
    return by_margin() & (F.col("top") >= MIN_COUNT) & (F.col("top") / F.col("total") >= ratio)


def active_by_field(pairs: DataFrame) -> DataFrame:
    """Pairs that may answer lookups, per field."""
    return pairs.filter((F.col("status") == "ativo") & F.col("campo").isin(*PARTIES)).select(
        "campo", "nome_key", "documento", "nome_original", "ocorrencias")


def active_global(pairs: DataFrame) -> DataFrame:
    """Active pairs summed over fields."""
    return active_by_field(pairs).groupBy("nome_key", "documento").agg(
        F.sum("ocorrencias").alias("ocorrencias"), F.min("nome_original").alias("nome_original"))


def memory_names(pairs: DataFrame) -> DataFrame:
    """documento → learned name where the leader is clear (J1, second level)."""
    rows = active_global(pairs).withColumn("_pick", F.col("nome_original"))
    return ranked(rows, ["documento"], "_pick").filter(by_margin()).select(
        F.col("documento").alias("doc"), F.col("_pick").alias("nome_memoria"))


def memory_documents(pairs: DataFrame) -> DataFrame:
    """(campo, nome_key) → learned id that passes the confidence rule."""
    rows = active_by_field(pairs)
    return ranked(rows, ["campo", "nome_key"], "documento").filter(confident(F.col("campo"))).select(
        "campo", F.col("nome_key").alias("key"), F.col("documento").alias("doc_memoria"))


def memory_documents_global(pairs: DataFrame) -> DataFrame:
    """nome_key → learned id when no field is given: only the margin applies."""
    return ranked(active_global(pairs), ["nome_key"], "documento").filter(by_margin()).select(
        F.col("nome_key").alias("key"), F.col("documento").alias("doc_memoria"))


# --- J1 ----------------------------------------------------------------------------------

def name_by_document(docs: DataFrame, registry: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(doc) → (doc, nome): registry first, then the learned memory."""
    known = registry.select(D.digits_only(F.col("doc")).alias("doc"), F.col("nome").alias("nome_registro"))
    out = docs.join(shuffled(known.filter(F.col("nome_registro") != "")), "doc", "left")
    if pairs is not None:
        out = out.join(shuffled(memory_names(pairs)), "doc", "left")
    else:
        out = out.withColumn("nome_memoria", F.lit(None).cast("string"))
    return out.select(*docs.columns, F.coalesce("nome_registro", "nome_memoria").alias("nome")).filter(
        F.col("nome").isNotNull())


def document_known(docs: DataFrame, registry: DataFrame, pairs: DataFrame) -> DataFrame:
    """Flag ids present in the registry or in learned pairs of any status."""
    known = (
        registry.select(D.digits_only(F.col("doc")).alias("doc"))
        .unionByName(pairs.select(F.col("documento").alias("doc"))).distinct().withColumn("_k", F.lit(True))
    )
    return docs.join(known, "doc", "left").withColumn("conhecido", F.coalesce("_k", F.lit(False))).drop("_k")


# --- J2–J5 -------------------------------------------------------------------------------

def registry_documents(keys: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry answer per name key (J4): ``situacao`` is unico, ambiguo or nenhum.

    ``ambiguo`` (several exact hits) stops the search; containment counts registry entries
    with at least 12 characters in the shorter key and needs exactly one.
    """
    base = registry.select(
        D.digits_only(F.col("doc")).alias("doc"), X.name_key(F.col("nome")).alias("key")).filter(F.col("key") != "")
    exact = base.groupBy("key").agg(F.min("doc").alias("_lo"), F.max("doc").alias("_hi"))
    near = containment_candidates(keys, base, [], MIN_CONTAINED)
    near = near.select("key", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("_near"))
    return (
        keys.join(shuffled(exact), "key", "left").join(shuffled(near), "key", "left")
        .select(
            "key",
            F.when(F.col("_lo").isNull(), F.col("_near"))
            .when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("doc_registro"),
            F.coalesce(F.col("_lo") != F.col("_hi"), F.lit(False)).alias("ambiguo"))
    )


def documents_by_name(questions: DataFrame, index: DataFrame, registry: DataFrame | None,
                      pairs: DataFrame | None) -> DataFrame:
    """Answers for distinct (filing_id, campo, nome_key): exact in the batch, contained in
    the batch, registry, memory — in this order (J2 → J3 → J4 → J5).  ``origem`` says which."""
    by = ["filing_id", "campo"]
    # The distinct questions and the index are stored once; every step below asks them again.
    q = kept(questions.select(*by, F.col("nome_key").alias("key")).filter(F.length("key") >= MIN_KEY).distinct())
    idx = kept(index.select(*by, F.col("nome_key").alias("key"), "doc"))
    exact = unique_doc(idx, by + ["key"]).withColumnRenamed("doc", "doc_exato")
    out = q.join(shuffled(exact), by + ["key"], "left")
    open_keys = out.filter(F.col("doc_exato").isNull() & (F.length("key") >= MIN_CONTAINED)).select(*by, "key")
    near = containment_candidates(open_keys, idx, by, MIN_KEY).select(
        *by, "key", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("doc_contido"))
    out = out.join(shuffled(near), by + ["key"], "left")

    none = F.lit(None).cast("string")
    if registry is not None:
        out = out.join(shuffled(registry_documents(q.select("key").distinct(), registry)), "key", "left")
    else:
        out = out.withColumns({"doc_registro": none, "ambiguo": F.lit(False)})
    if pairs is not None:
        memory = memory_documents(pairs)
        out = out.join(shuffled(memory), ["campo", "key"], "left").withColumn(
            "doc_memoria", F.when(X.memory_key(F.col("key")) != "", F.col("doc_memoria")))
    else:
        out = out.withColumn("doc_memoria", none)

    late = F.when(F.col("ambiguo"), none).otherwise(F.coalesce("doc_registro", "doc_memoria"))
    doc = F.coalesce(F.col("doc_exato"), F.col("doc_contido"), late)
    source = (
        F.when(F.col("doc_exato").isNotNull(), "lote_exato")
        .when(F.col("doc_contido").isNotNull(), "lote_contido")
        .when(F.col("doc_registro").isNotNull() & ~F.col("ambiguo"), "registro")
        .otherwise("memoria"))
    return out.select(*by, F.col("key").alias("nome_key"), doc.alias("doc"), source.alias("origem")).filter(
        F.col("doc").isNotNull())


# --- J6, J7 ------------------------------------------------------------------------------

def fixes(records: DataFrame, registry: DataFrame | None, pairs: DataFrame | None,
          infer_documents: bool = True) -> DataFrame:
    """Long table of corrections: filing_id, seq, campo, doc_novo, nome_novo, origem."""
    rows = party_rows(records, "destinatario_exterior").filter(
        ~((F.col("campo") == "destinatario") & F.coalesce(F.col("destinatario_exterior"), F.lit(False))))
    nome_len = F.length(F.coalesce("nome", F.lit("")))
    nameless = rows.filter((F.length("doc") == 14) & (nome_len < 2))
    dims = registry if registry is not None else records.select(
        F.lit("").alias("doc"), F.lit("").alias("nome")).limit(0)
    names = name_by_document(nameless.select("doc").distinct(), dims, pairs).withColumnRenamed("nome", "nome_novo")
    out = nameless.join(shuffled(names), "doc").select(
        "filing_id", "seq", "campo", F.lit(None).cast("string").alias("doc_novo"), "nome_novo",
        F.lit("nome").alias("origem"))
    if infer_documents:
        missing = rows.filter((F.col("doc").isNull() | (F.col("doc") == D.ZERO_DOC)) & (nome_len >= MIN_KEY))
        answers = documents_by_name(missing, batch_name_index(records), registry, pairs)
        out = out.unionByName(
            missing.join(shuffled(answers.withColumnRenamed("doc", "doc_novo")), ["filing_id", "campo", "nome_key"]).select(
                "filing_id", "seq", "campo", "doc_novo", F.lit(None).cast("string").alias("nome_novo"), "origem"))
    return out


def fill_documents_and_names(records: DataFrame, registry: DataFrame | None = None,
                             pairs: DataFrame | None = None, infer_documents: bool = True) -> DataFrame:
    """Apply fixes(); adds ``dados_corrigidos`` (record changed) and ``n_campos``.

    ``infer_documents=False`` is the earlier, names-only mode (J7), which counts fields.
    """
    wide = fixes(records, registry, pairs, infer_documents).groupBy("filing_id", "seq").agg(
        F.count(F.lit(1)).alias("n_campos"),
        *[F.max(F.when(F.col("campo") == p, F.col("doc_novo"))).alias(f"_{p}_doc") for p in PARTIES],
        *[F.max(F.when(F.col("campo") == p, F.col("nome_novo"))).alias(f"_{p}_nome") for p in PARTIES])
    joined = records.join(shuffled(wide), ["filing_id", "seq"], "left")
    new = {f"{p}_cnpj": F.coalesce(f"_{p}_doc", f"{p}_cnpj") for p in PARTIES}
    new |= {f"{p}_nome": F.coalesce(f"_{p}_nome", f"{p}_nome") for p in PARTIES}
    new["n_campos"] = F.coalesce("n_campos", F.lit(0))
    out = joined.withColumns(new).drop(*[f"_{p}_doc" for p in PARTIES], *[f"_{p}_nome" for p in PARTIES])
    return out.withColumn("dados_corrigidos", F.col("n_campos") > 0)
