"""Invoice deduplication and merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cargofile.functions import text as X
from cargofile.schema import RECEIVER_MISSING, RECORD_OPTIONAL, RECORD_TEXT, as_records


def dedup_merge(records: DataFrame, key_cols: tuple[str, ...] = ("filing_id",)) -> DataFrame:
    """One row per invoice: the first record, blanks filled from later ones in order.

    The key is the invoice number, else the freight-bill number; rows with neither are
    dropped.  ``key_cols`` may be widened (for example with the issuer id).  Each column is
    one ``min_by`` over the rows where it has a value: a partial aggregate, so a hot key is
    reduced before the shuffle and no row list is ever built.
    """
    df = as_records(records)
    nf, cte = X.clean(F.col("nf_numero")), X.clean(F.col("cte_numero"))
    keyed = df.withColumn("chave", F.coalesce(nf, F.concat(F.lit("CTE_"), cte))).filter(F.col("chave").isNotNull())
    group = list(dict.fromkeys(list(key_cols) + ["chave"]))
    first = [
        F.min_by(F.col(c), F.when(X.clean(F.col(c)).isNotNull(), F.col("seq"))).alias(c)
        for c in RECORD_TEXT + RECORD_OPTIONAL if c not in group
    ]
    merged = keyed.groupBy(*group).agg(
        F.min("seq").alias("seq"),
        F.coalesce(F.max("destinatario_exterior"), F.lit(False)).alias("destinatario_exterior"),
        F.count(F.lit(1)).alias("n_registros"),
        *first,
        *([] if "filing_id" in group else [F.min("filing_id").alias("filing_id")]),
    )
    fallback = [X.clean(F.col(c)) for c in ("destinatario_nome", "contratante_nome", "emitente_nome")]
    return merged.withColumn("recebedor", F.coalesce(F.col("recebedor"), *fallback, F.lit(RECEIVER_MISSING)))
