"""Small builders and plain-Python counterparts used to check the Spark jobs."""

from cargofile.schema import RECORD_SCHEMA


def cnpj(body12: str) -> str:
    w1 = (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
    w2 = (6,) + w1
    for w in (w1, w2):
        r = sum(int(d) * x for d, x in zip(body12, w)) % 11
        body12 += str(0 if r < 2 else 11 - r)
    return body12


def cpf(body9: str) -> str:
    for n in (10, 11):
        r = sum(int(d) * (n - i) for i, d in enumerate(body9)) % 11
        body9 += str(0 if r < 2 else 11 - r)
    return body9


A, B, C = cnpj("112223330001"), cnpj("445556660001"), cnpj("778889990001")
P = cpf("123456789")


def records(spark, rows):
    """Records from dicts; filing_id and seq get defaults."""
    full = []
    for i, r in enumerate(rows):
        r = {"filing_id": "F1", "seq": i + 1, "destinatario_exterior": False, **r}
        full.append(tuple(r.get(f.name) for f in RECORD_SCHEMA.fields))
    return spark.createDataFrame(full, RECORD_SCHEMA)


def good(**over):
    base = dict(
        nf_numero="31967", nf_data="02/02/2026", emitente_cnpj=A, emitente_nome="ALFA QUIMICA LTDA",
        contratante_cnpj=A, contratante_nome="ALFA QUIMICA LTDA", destinatario_cnpj=B,
        destinatario_nome="BETA INDUSTRIA S/A", cte_numero="4800503", cte_data="03/02/2026",
        data_entrega="10/02/2026", recebedor="JOSE DA SILVA", local_retirada="p", local_entrega="p")
    return {**base, **over}


def foreign(**over):
    return good(**{**dict(
        nf_numero="411574", destinatario_cnpj="", destinatario_exterior=True, destinatario_nome="GAMMA BELGIUM BV",
        destinatario_texto="DESTINATÁRIO\nGAMMA BELGIUM BV\nCNPJ/CPF:\nEND: CHAUSSEE DE HAECHT, 1465 - HAREN\n"
                           "CEP: 99999-999 CIDADE: EXTERIOR - EX"), **over})


def tn(contr=A, origin=A, dest=B, nf="12345", pickup="P", delivery="P", name="EMPRESA CONTRATANTE", dname="DESTINO DA CARGA", oname="ORIGEM DA CARGA"):
    return ("TN" + contr.rjust(14) + name.ljust(70) + nf.ljust(10) + "01/02/2026" + origin.rjust(14) + oname.ljust(70)
            + dest.rjust(14) + dname.ljust(70) + pickup + delivery)


def cc(modal="RO"):
    return "CC" + "123456789" + "01/02/2026" + "02/02/2026" + "RESPONSAVEL".ljust(70) + modal


def ti(storage="P"):
    return "TI" + "EO" + "411574".ljust(10) + "13/03/2026" + A + "EMPRESA".ljust(70) + storage


def pi(country="056"):
    return "PI" + "GAMMA BELGIUM BV".ljust(70) + country.rjust(3) + "RUA NORTE".ljust(70)


def sub(tipo):
    return tipo + C + "ARMAZEM".ljust(70)


EM = "EM" + A + "FEV202600000010"


def lines(spark, *files):
    rows = [(f"F{i}", n, v) for i, f in enumerate(files) for n, v in enumerate(f, 1)]
    return spark.createDataFrame(rows, "filing_id string, line_no bigint, value string")


def write(path, data: bytes):
    with open(path, "wb") as f:
        f.write(data)
