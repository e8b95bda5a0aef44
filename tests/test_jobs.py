"""Rendering round trip, enrichment against brute force, learning, extraction, resolutions."""

import itertools
import random

import pytest
from helpers import A, B, C, P, cnpj, foreign, good, lines, records, tn
from pyspark.sql import functions as F

from cargofile.functions import text as X
from cargofile.operators import dedup, enrich, extract, learn, lines as N, render, report, resolve, validate
from cargofile.plans import jobs
from cargofile.sources import filings as S, tables
from cargofile.schema import PAIR_SCHEMA


def header(spark, *ids):
    return spark.createDataFrame([(i, A, 2, 2026) for i in ids], "filing_id string, cnpj string, mes int, ano int")


def one(spark, expr_of, value):
    return spark.createDataFrame([(value,)], "v string").select(expr_of(F.col("v"))).first()[0]


def test_text_forms(spark):
    assert one(spark, lambda c: X.fixed_alnum(c, 10), "00ab-12/ç") == "AB12C     "
    assert one(spark, X.flat_text, "  Ação\nde  Straße… ½ ☃ Ø") == "ACAO DE STRASSE... 1/2 O"
    assert one(spark, X.name_key, "  Café & Cia. — Ltda ") == "CAFE CIA LTDA"
    assert one(spark, X.name_key, "n/a") == ""
    assert one(spark, lambda c: X.fixed_number(c, 4), "123456") == "123456"
    for text, ok in (("29/02/2024", True), ("29/02/2023", False), ("31/4/2020", False), ("1/1/0000", False), ("1/1/0001", True)):
        assert one(spark, X.is_calendar_date, text) is ok


def test_round_trip(spark, tmp_path):
    rows = [good(), good(nf_numero="32005", destinatario_cnpj=P), foreign(), good(nf_numero="1", cte_numero=None),
            good(nf_numero="2222", local_retirada="A", retirada_cnpj=C, retirada_nome="ARMAZÉM SUL")]
    recs = records(spark, rows)
    out = render.numbered_filings(recs, header(spark, "F1"))
    got = [(r.tipo, r.value) for r in out.orderBy("line_no").collect()]
    assert [t for t, _ in got] == ["EM", "TN", "CC", "TN", "CC", "TI", "PI", "TN", "TN", "CC", "LR"]
    assert got[3][1][190:204] == "   " + P and got[6][1][72:75] == "056"
    status = jobs.write_checked(spark, out, str(tmp_path / "out"))
    assert [(r.filing_id, r.total_linhas, r.valido) for r in status.collect()] == [("F1", 11, True)]
    # A filing beyond the size of one file is written in parts that read back as one.
    S.write_filings(out, str(tmp_path / "parts"), max_lines=4)
    back = S.read_back(spark, str(tmp_path / "parts")).orderBy("line_no").collect()
    assert [r.value for r in back] == [v for _, v in got]
    # The plain order-key numbering agrees.
    plain = render.number_lines(render.assemble_filings(recs, header(spark, "F1")))
    assert sorted((r.line_no, r.value) for r in plain.collect()) == [(i, v) for i, (_, v) in enumerate(got, 1)]


def test_render_rules(spark):
    bad = records(spark, [good(destinatario_cnpj=""), good(emitente_cnpj=P), good(destinatario_nome="ASSOCIACAO BENEFICENTE",
                          recebedor="ASSOCIACAO BENEFICENTE"), good(recebedor="ASSINATURA"), good(cte_numero="0")])
    errors = [r.mensagem for r in render.render_errors(bad).orderBy("seq").collect()]
    assert "vazio no PDF" in errors[0] and "exige CNPJ" in errors[1] and len(errors) == 2
    alerts = {r.seq: r.mensagem for r in render.render_alerts(bad).collect()}
    assert 3 not in alerts
    assert "Substituído por 'BETA INDUSTRIA S/A'" in alerts[4] and "não gerada" in alerts[5]


def test_dedup_first_value_wins(spark):
    recs = records(spark, [
        good(recebedor=None, cte_data=None), good(cte_data="09/09/2020", emitente_nome="OUTRO"), good(nf_numero=None, cte_numero="7"),
        good(nf_numero=None, cte_numero=None)])
    rows = {r.chave: r for r in dedup.dedup_merge(recs).collect()}
    assert set(rows) == {"31967", "CTE_7"}
    assert rows["31967"].cte_data == "09/09/2020" and rows["31967"].emitente_nome == "ALFA QUIMICA LTDA"
    assert rows["31967"].recebedor == "JOSE DA SILVA" and rows["31967"].n_registros == 2


def test_containment_equals_brute_force(spark):
    """Random nested names, one of them inside a third of all the others."""
    rnd = random.Random(3)
    words = ["COMERCIO", "NORTE", "QUIMICA", "ALFA", "TINTAS", "DO", "SUL", "BETA"]
    names = {" ".join(rnd.choices(words, k=rnd.randint(1, 5))) for _ in range(250)} | {"COMERCIO NORTE"}
    idx = [(n, f"{rnd.randint(0, 40):014d}") for n in names if len(n) >= 8 for _ in range(rnd.choice([1, 1, 2]))]
    qs = [n[: rnd.randint(12, 40)].strip() for n in names if len(n) >= 12] + [n for n in names if len(n) >= 12][:40]
    qs = sorted({x for x in qs if len(x) >= 12})
    got = {r.key: (r.lo, r.hi) for r in enrich.containment_candidates(
        spark.createDataFrame([(x,) for x in qs], "key string"), spark.createDataFrame(idx, "key string, doc string"), [], 8).collect()}
    want = {}
    for x in qs:
        docs = [d for n, d in idx if x in n or n in x]
        if docs:
            want[x] = (min(docs), max(docs))
    assert got == want and len(want) > 50


def test_fill_documents(spark):
    recs = records(spark, [
        good(), good(nf_numero="2", emitente_cnpj=None), good(nf_numero="3", destinatario_cnpj="0" * 14, destinatario_nome="Beta Indústria S/A Filial"),
        good(nf_numero="4", contratante_nome="", contratante_cnpj=C), good(nf_numero="5", emitente_cnpj="", emitente_nome="DELTA DESCONHECIDA")])
    registry = spark.createDataFrame([(C, "CASA GAMA")], "doc string, nome string")
    rows = {r.seq: r for r in enrich.fill_documents_and_names(recs, registry).collect()}
    assert rows[2].emitente_cnpj == A and rows[3].destinatario_cnpj == B and rows[4].contratante_nome == "CASA GAMA"
    assert rows[5].emitente_cnpj == "" and not rows[5].dados_corrigidos and rows[1].n_campos == 0
    kept = enrich.fill_documents_and_names(recs, registry, infer_documents=False)
    assert {r.seq for r in kept.filter("dados_corrigidos").collect()} == {4}


def test_learning_and_replay(spark, tmp_path):
    store = tables.MemoryStore(spark, str(tmp_path / "mem"))
    first = lines(spark, [tn(nf="1001", oname="LAB CENTRAL"), tn(nf="1002", oname="LAB CENTRAL")])
    run = jobs.learn_files(spark, first, store, "a.txt", "2026-01-01")
    assert not run["replay_detectado"] and run["ativos_sessao"] == 3
    docs = {(r.campo, r.key): r.doc_memoria for r in enrich.memory_documents(store.pairs()).collect()}
    assert docs[("emitente", "LAB CENTRAL")] == A and ("destinatario", "LAB CENTRAL") not in docs
    assert jobs.learn_files(spark, first, store, "a.txt", "2026-01-02")["replay_detectado"]
    clash = lines(spark, [tn(nf="9", oname="LAB CENTRAL", origin=C), tn(nf="8", oname="LAB CENTRAL", origin=C)])
    run = jobs.learn_files(spark, clash, store, "b.txt", "2026-01-03")
    assert run["rebaixados"] == 0 and run["aprendidos_novos"] == 1
    left = {r.documento: r.status for r in store.pairs().filter("campo = 'emitente'").collect()}
    assert left == {A: "quarentena", C: "quarentena"}
    assert store.last_session() == 2 and store.items().count() == 6


def test_sample_is_exact(spark):
    nfs = [str(i) for i in range(1, 400)]
    text = lines(spark, [tn(nf=n) for n in nfs])
    got = learn.learn_candidates(text).filter("campo = 'emitente'").first()
    assert got.nf_amostra == ",".join(sorted(nfs))[:120] and got.ocorrencias == len(nfs)


def test_receiver_and_layout(spark):
    from cargofile.functions import extraction as E
    for t, want in (("RECEBEDOR: - DATA ENTREGA: 10/02/2026 18:10", None), ("RECEBEDOR: ASSINATURA DATA ENTREGA: 10/02/2026", None),
                    ("RECEBEDOR: RUBRICA DATA ENTREGA: 1", None), ("RECEBEDOR: JOSE DA SILVA DATA ENTREGA: 10/02/2026 18:10", "JOSE DA SILVA"),
                    ("RECEBIDO POR: ANA", "ANA"), ("Responsável pelo recebimento: Léo", "Léo")):
        assert one(spark, E.extract_receiver, t) == want
    mask = lambda d: f"{d[:2]}.{d[2:5]}.{d[5:8]}/{d[8:12]}-{d[12:]}"
    D2 = cnpj("998887770002")
    for t, want in ((f"CNPJ/CPF: {mask(A)} FONE", A), (f"x {D2} y", D2), ("fone 11944445555", None), (f"CPF: {P}", P), (f"EMITENTE{B}", B)):
        assert one(spark, E.extract_document, t) == want
    pages = spark.createDataFrame([("R1", 1, "EMITENTE DESTINATÁRIO CONTRATANTE CT-E CNPJ/CPF"), ("R2", 1, "EMITENTE")], "filing_id string, page_no bigint, text string")
    got = {r.filing_id: (r.valido, list(r.faltando)) for r in extract.check_report_layout(pages).collect()}
    assert got["R1"] == (True, []) and got["R2"] == (False, ["DESTINATARIO", "CONTRATANTE", "CTE", "CNPJ_CPF"])


def test_tables_before_text(spark):
    m = lambda d: f"{d[:2]}.{d[2:5]}.{d[5:8]}/{d[8:12]}-{d[12:]}"
    cells = [["EMITENTE\nALFA LTDA\nCNPJ/CPF: " + m(A), "DESTINATÁRIO\nBETA SA\nCNPJ/CPF: " + m(B)], ["Nº CT-E: 77 DATA: 01/02/2026"],
             ["QUANTIDADE\n2.0", "UNIDADE\nPC", "DATA NF\n29/12/2025", "NF\n11288"], ["3", "PC", "30/12/2025", "11289"], ["só texto"]]
    rows = spark.createDataFrame([("R", 1, 1, i, c) for i, c in enumerate(cells)], "filing_id string, page_no bigint, table_no int, row_no int, cells array<string>")
    block = f"EMITENTE\nALFA\nCNPJ/CPF: {m(A)}\nNF: 5555 01/01/2026\nNº CT-E: 12\n"
    pages = spark.createDataFrame([("R", 1, block), ("R", 2, block)], "filing_id string, page_no bigint, text string")
    got = [(r.nf_numero, r.nf_data, r.contratante_cnpj, r.destinatario_cnpj) for r in extract.extract_records(pages, rows).orderBy("seq").collect()]
    assert got == [("11288", "29/12/2025", A, B), ("11289", "30/12/2025", A, B), ("5555", "01/01/2026", A, None)]


def test_repair_equals_brute_force(spark):
    def valid(d):
        return len(set(d)) > 1 and d == cnpj(d[:12])
    d = A
    texts = [f"{d[:2]}9.{d[2:5]}.{d[5:8]}1/{d[8:12]}-{d[12:]}", f"{d[:2]}.{d[2:5]}.{d[5:8]}/{d[8:12]}-{d[12:]}".replace("1", "I").replace("0", "O"),
             "12345.67890.12345/678901-2345", f"{d[:2]} .{d[2:5]}.{d[5:8]}/{d[8:12]}-{d[12:]}", "nada aqui"]
    want = {}
    for t in texts:
        token = t.upper().translate(str.maketrans("OQDIL|!ZSBGT", "000111125867")).replace(" .", ".")
        try:
            a, b, rest = token.split(".")
            c, rest = rest.split("/")
            e, f = rest.split("-")
        except ValueError:
            continue
        parts = [["".join(x) for x in itertools.combinations(g, k)] for g, k in zip((a, b, c, e, f), (2, 3, 3, 4, 2))]
        found = {"".join(x) for x in itertools.islice(itertools.product(*parts), 45000) if valid("".join(x))}
        if len(found) == 1:
            want[t] = found.pop()
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.text: r.doc for r in extract.repair_documents(df).collect()} == want and len(want) >= 2


def test_resolutions(spark):
    recs = records(spark, [good(emitente_cnpj=None), good(nf_numero="2", destinatario_cnpj=""), good(nf_numero="3", contratante_cnpj=None)])
    ans = spark.createDataFrame([("F1", "31967", "emitente_cnpj", P), ("F1", "2", "destinatario_cnpj", P), ("F1", "9", "emitente_cnpj", A)],
                                "filing_id string, nf_numero string, campo string, documento string")
    got = {(r.nf, r.problema) for r in resolve.resolution_problems(recs, ans).collect()}
    assert got == {("31967", "documento_invalido"), ("9", "pendencia_inexistente"), ("3", "documento_faltante")}
    assert resolve.apply_resolutions(recs, ans).filter("seq = 2").first().destinatario_cnpj == P
    with pytest.raises(ValueError):
        resolve.require_resolved(resolve.resolution_problems(recs, ans))


def test_convert_job(spark):
    recs = jobs.prepare_records(records(spark, [good(), good(recebedor="RUBRICA", nf_numero="4444"), foreign()]))
    out = jobs.convert(recs, header(spark, "F1"))
    stats = out.statistics.first()
    assert stats.total_aprovados == 3 and stats.total_corrigidos == 1 and stats.total_com_erros_criticos == 0
    assert N.filing_status(out.lines).first().valido and out.problems.isEmpty() and out.unrendered.isEmpty()
    assert out.adjustments.filter("tipo = 'ACAO_NECESSARIA'").isEmpty()


def test_hot_filing_is_sliced(spark):
    """The plan for line numbers never windows over a bare filing of lines."""
    df = spark.range(1000).selectExpr("'F' as filing_id", "id as ordem", "'TN' as value")
    plan = render.number_lines(df)._jdf.queryExecution().executedPlan().toString()
    window = [p for p in plan.splitlines() if "Window [" in p]
    assert window and all("_slice" in p for p in window)


def test_slices_stay_bounded_with_an_outlier_and_a_dense_cluster(spark):
    from cargofile.operators import ordered

    rows = [(i,) for i in range(3000)] + [(9 * 10**12,), (2**62 + 5,)] + [(2**62 + 100 + i,) for i in range(500)]
    df = spark.createDataFrame(rows, "o long").withColumn("g", F.lit("F")).repartition(4)
    sliced = ordered.with_slice(df, ["g"], "o", rows=100)
    sizes = sliced.groupBy("g", "_slice").count().collect()
    assert max(r["count"] for r in sizes) <= 200 and len(sizes) >= 35
    ordinals = {r.o: r.n for r in ordered.number_rows(df, ["g"], "o", "n", rows=100).collect()}
    assert ordinals == {o: k for k, (o,) in enumerate(sorted(rows), 1)}


def test_ids_of_a_text_block(spark):
    """Masked ids keep their order and repeats; later tiers only add new ids."""
    from cargofile.functions import extraction as E

    m = lambda d: f"{d[:2]}.{d[2:5]}.{d[5:8]}/{d[8:12]}-{d[12:]}"
    for text, want in (
            (f"{m(A)} {m(A)} {m(B)}", [A, A, B]), (f"{m(A)} {m(B)} {m(C)} {m(A)}", [A, B, C]), (f"{m(A)} x\nCNPJ: {A}\nCNPJ: {C}", [A, C]),
            (f"{m(A)} {m(B)}\nFONE: (11) 4444-5555", [A, B]), (f"CNPJ/CPF: {A}\nCPF: {P}", [A, P]), ("FONE 11944445555", [])):
        assert one(spark, E.block_documents, text) == want
    page = f"EMITENTE\nALFA\nCNPJ/CPF: {m(A)}\nCONTRATANTE\nALFA\nCNPJ/CPF: {m(A)}\nDESTINATÁRIO\nBETA\nCNPJ/CPF: {m(B)}\nNF: 5555\nNº CT-E: 12\n"
    row = extract.extract_records_from_text(spark.createDataFrame([("R", 1, page)], "filing_id string, page_no bigint, text string")).first()
    assert (row.emitente_cnpj, row.contratante_cnpj, row.destinatario_cnpj) == (A, A, B)


def test_many_tables_on_a_page(spark):
    """Table numbers from 255 on neither hide the text of other pages nor collide with text."""
    m = lambda d: f"{d[:2]}.{d[2:5]}.{d[5:8]}/{d[8:12]}-{d[12:]}"
    cells = [["EMITENTE\nALFA LTDA\nCNPJ/CPF: " + m(A)], ["Nº CT-E: 77 DATA: 01/02/2026"], ["QUANTIDADE\n2.0", "DATA NF\n29/12/2025", "NF\n11288"]]
    rows = spark.createDataFrame([("R", 1, t, i, c) for t in (255, 256, 70000) for i, c in enumerate(cells)],
                                 "filing_id string, page_no bigint, table_no int, row_no int, cells array<string>")
    block = f"EMITENTE\nALFA\nCNPJ/CPF: {m(A)}\nNF: 5555 01/01/2026\nNº CT-E: 12\n"
    pages = spark.createDataFrame([("R", 1, block), ("R", 2, block * 3)], "filing_id string, page_no bigint, text string")
    got = extract.extract_records(pages, rows).orderBy("seq").collect()
    assert [r.nf_numero for r in got] == ["11288"] * 3 + ["5555"] * 3 and len({r.seq for r in got}) == 6


def test_repair_reads_every_combination(spark):
    """A token with far more readings than any fixed number of tries."""
    def valid(d):
        return len(set(d)) > 1 and d == cnpj(d[:12])
    for token in ("11111111.22222222.00000000/55555555-" + cnpj("112220005555")[12:], "12345678.11111111.00000000/22222222-99"):
        a, b, rest = token.split(".")
        c, rest = rest.split("/")
        e, f = rest.split("-")
        parts = [sorted({"".join(x) for x in itertools.combinations(g, k)}) for g, k in zip((a, b, c, e, f), (2, 3, 3, 4, 2))]
        found = {d for d in map("".join, itertools.product(*parts)) if valid(d)}
        df = spark.createDataFrame([(token,)], "text string")
        got = [r.doc for r in extract.repair_documents(df).collect()]
        assert got == (list(found) if len(found) == 1 else [])


def test_incomplete_filings_are_blocked(spark, tmp_path):
    rows = [good(), good(filing_id="F2"), good(filing_id="F2", nf_numero="2", emitente_cnpj=P), good(filing_id="F3")]
    heads = spark.createDataFrame([("F1", A, 2, 2026, "a"), ("F2", A, 2, 2026, "b"), ("F3", A, 13, 2026, "c")],
                                  "filing_id string, cnpj string, mes int, ano int, relatorio string")
    out = jobs.convert(jobs.prepare_records(records(spark, rows)), heads)
    assert {r.filing_id for r in out.lines.select("filing_id").distinct().collect()} == {"F1"}
    assert {(r.filing_id, r.motivo) for r in out.blocked.collect()} >= {("F2", "registros"), ("F3", "cabecalho")}
    with pytest.raises(ValueError, match="F2"):
        jobs.require_unblocked(out.blocked)
    # The next batch leaves earlier filings in the folder alone; folders bear the file names.
    first = jobs.write_checked(spark, out.lines, str(tmp_path / "o"), filings=heads.filter("filing_id = 'F1'"))
    again = out.lines.withColumn("filing_id", F.lit("F9"))
    jobs.write_checked(spark, again, str(tmp_path / "o"))
    assert [(r.filing_id, r.valido) for r in first.collect()] == [(f"M2026FEV{A}_A.txt", True)]
    assert S.read_back(spark, str(tmp_path / "o")).select("filing_id").distinct().count() == 2


def test_numbering_reads_rendered_records_from_storage(spark):
    """Its passes must not render every record again (F32)."""
    out = render.numbered_filings(records(spark, [good(), good()]), header(spark, "F1"))
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r.line_no for r in out.orderBy("line_no").collect()] == list(range(1, out.count() + 1))


def test_flat_text_and_keys_are_told_by_bytes_and_blanks(spark):
    """Texts that need no work are told without groups of a regular expression, and ASCII keys need no table."""
    cases = {"A B": ("A B", "A B"), "A  B": ("A B", "A B"), "a&b": ("A&B", "A B"), "É - ção ": ("E - CAO", "E CAO"),
             "straße": ("STRASSE", "STRASSE"), "": ("", ""), " ": ("", ""), "A\tB\n": ("A B", "A B"), None: (None, "")}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    df = X.flatten_columns(df, {"f": X.strip(F.col("t"))}).select("i", "f", X.name_key(F.col("t")).alias("k")).orderBy("i")
    assert [(r.f, r.k) for r in df.collect()] == list(cases.values())
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "(?: [" not in plan
