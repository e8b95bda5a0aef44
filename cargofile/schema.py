"""Fixed schemas and the positional layout that drives both reader and writer."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F, types as T

PARTIES = ("emitente", "contratante", "destinatario")

# Text columns of an invoice record, besides the lineage pair (filing_id, seq).
RECORD_TEXT = (
    "nf_numero", "nf_data",
    "emitente_cnpj", "emitente_nome",
    "contratante_cnpj", "contratante_nome",
    "destinatario_cnpj", "destinatario_nome", "destinatario_texto",
    "cte_numero", "cte_data", "data_entrega", "recebedor",
    "local_retirada", "local_entrega",
)
# Columns a record may carry for foreign transport and third-party storage.
RECORD_OPTIONAL = (
    "destinatario_pais_id", "pais_destino_id", "pais_id",
    "destinatario_pais", "pais_destino", "pais",
    "destinatario_endereco", "endereco_destinatario", "endereco_internacional",
    "operacao_internacional", "contratante_internacional",
    "empresa_cnpj", "empresa_nome", "pessoa_internacional_nome",
    "local_armazenamento", "local_armazenamento_cnpj", "local_armazenamento_nome",
    "armazenagem_cnpj", "armazenagem_nome",
    "retirada_cnpj", "retirada_nome", "entrega_cnpj", "entrega_nome",
)

RECORD_SCHEMA = T.StructType(
    [T.StructField("filing_id", T.StringType()), T.StructField("seq", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in RECORD_TEXT + RECORD_OPTIONAL]
    + [T.StructField("destinatario_exterior", T.BooleanType())]
)

PAIR_SCHEMA = T.StructType([
    T.StructField("nome_key", T.StringType()),
    T.StructField("nome_original", T.StringType()),
    T.StructField("documento", T.StringType()),
    T.StructField("tipo_documento", T.StringType()),
    T.StructField("campo", T.StringType()),
    T.StructField("ocorrencias", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("status_motivo", T.StringType()),
    T.StructField("origem_arquivo", T.StringType()),
    T.StructField("primeira_ocorrencia", T.StringType()),
    T.StructField("ultima_ocorrencia", T.StringType()),
])

SESSION_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("arquivo_txt", T.StringType()),
    T.StructField("arquivo_sha256", T.StringType()),
    T.StructField("processado_em", T.StringType()),
    T.StructField("total_tn", T.LongType()),
    T.StructField("candidatos", T.LongType()),
    T.StructField("aprendidos", T.LongType()),
    T.StructField("atualizados", T.LongType()),
    T.StructField("ignorados", T.LongType()),
    T.StructField("linhas_invalidas", T.LongType()),
])

RECEIVER_MISSING = "NAO INFORMADO"
MISSING_TOKENS = ("NONE", "NULL", "N/A", "NA", "NAN")
SEVERITIES = ("CRITICO", "ERRO", "AVISO")


class Field(NamedTuple):
    name: str
    start: int
    length: int
    kind: str = "text"      # text | doc


# Widths and 1-based offsets of the filing format.
LAYOUT: dict[str, tuple[Field, ...]] = {
    "EM": (
        Field("cnpj", 3, 14, "doc"), Field("mes", 17, 3), Field("ano", 20, 4), Field("flags", 24, 8),
    ),
    "TN": (
        Field("contratante_cnpj", 3, 14, "doc"), Field("contratante_nome", 17, 70),
        Field("nf_numero", 87, 10), Field("nf_data", 97, 10),
        Field("emitente_cnpj", 107, 14, "doc"), Field("emitente_nome", 121, 70),
        Field("destinatario_cnpj", 191, 14, "doc"), Field("destinatario_nome", 205, 70),
        Field("local_retirada", 275, 1), Field("local_entrega", 276, 1),
    ),
    "CC": (
        Field("cte_numero", 3, 9), Field("cte_data", 12, 10), Field("data_recebimento", 22, 10),
        Field("recebedor", 32, 70), Field("modal", 102, 0),       # 0 = to the end of the line
    ),
    "TI": (
        Field("operacao", 3, 1), Field("contratante", 4, 1), Field("nf_numero", 5, 10),
        Field("nf_data", 15, 10), Field("empresa_cnpj", 25, 14, "doc"),
        Field("empresa_nome", 39, 70), Field("local_armazenamento", 109, 1),
    ),
    "PI": (
        Field("nome_empresa", 3, 70), Field("pais_id", 73, 3), Field("endereco", 76, 70),
    ),
    "LA": (Field("documento", 3, 14, "doc"), Field("nome", 17, 70)),
    "LR": (Field("documento", 3, 14, "doc"), Field("nome", 17, 70)),
    "LE": (Field("documento", 3, 14, "doc"), Field("nome", 17, 70)),
}
WIDTH = {"EM": 31, "TN": 276, "CC": 103, "TI": 109, "LA": 86, "LR": 86, "LE": 86, "PI": 145}
MODALS = ("AE", "AQ", "FE", "RO")
MONTHS = ("JAN", "FEV", "MAR", "ABR", "MAI", "JUN", "JUL", "AGO", "SET", "OUT", "NOV", "DEZ")
ACTIVITIES = (
    "comercializacao_nacional", "comercializacao_internacional", "producao", "transformacao",
    "consumo", "fabricacao", "transporte", "armazenamento",
)
YEAR_RANGE = (2000, 2100)

# Country tokens searched in this order, with their 3-digit codes.
COUNTRY_TOKENS = (
    ("BELGIUM", "056"), ("BELGICA", "056"), ("BELGIQUE", "056"),
    ("UNITED STATES", "840"), ("ESTADOS UNIDOS", "840"), ("USA", "840"),
    ("ARGENTINA", "032"), ("CHILE", "152"), ("CHINA", "156"),
    ("GERMANY", "276"), ("ALEMANHA", "276"),
    ("FRANCE", "250"), ("FRANCA", "250"),
    ("ITALY", "380"), ("ITALIA", "380"),
    ("MEXICO", "484"),
    ("NETHERLANDS", "528"), ("HOLANDA", "528"), ("PAISES BAIXOS", "528"),
    ("PARAGUAY", "600"), ("PARAGUAI", "600"),
    ("PORTUGAL", "620"),
    ("SPAIN", "724"), ("ESPANHA", "724"),
    ("URUGUAY", "858"), ("URUGUAI", "858"),
)


def as_records(df: DataFrame) -> DataFrame:
    """Align any record-like DataFrame with RECORD_SCHEMA; absent columns become null."""
    have = set(df.columns)
    cols = []
    for f in RECORD_SCHEMA.fields:
        c = F.col(f.name) if f.name in have else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)
