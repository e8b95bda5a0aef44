"""Line rules, cross-line rules and file reading."""

import random

import pytest
from helpers import A, B, EM, P, cc, lines, pi, sub, ti, tn, write
from pyspark.sql import functions as F

from cargofile.functions import documents as D
from cargofile.operators import lines as N, ordered
from cargofile.sources import filings as S, shared


def messages(spark, *files):
    out = {}
    for r in N.all_errors(lines(spark, *files)).collect():
        out.setdefault(r.filing_id, []).append(r.mensagem)
    return out


def test_reference_cases(spark):
    short = "TN" + "12345678000199" + "NOME CURTO".ljust(35)
    files = [
        [EM, short], [EM, tn(), cc("ROAE")], [EM, tn(pickup="A"), cc()], [EM, tn(pickup="A"), cc(), sub("LR")],
        [EM, tn(dest="000" + P), cc()], [EM, tn(dest=P), cc()], [EM, tn(dest=""), cc()],
        [EM, ti(), pi()], [EM, ti()], [EM, ti(), pi("")], [EM, ti("A"), pi()], [EM, tn(), pi()], [tn()], [EM, EM]]
    got = messages(spark, *files)
    has = lambda i, text: any(text in m for m in got.get(f"F{i}", []))
    assert has(0, "begin 16, end 86, length 51")
    assert "F1" not in got and "F3" not in got and "F5" not in got and "F7" not in got
    assert has(2, "subsecao LR") and has(4, "CPF preenchido com zeros a esquerda")
    assert has(6, "CPF/CNPJ Destino Carga vazio") and has(8, "subsecao PI") and has(9, "Id do pais")
    assert has(10, "subsecao LA") and has(11, "vinculada a uma linha TI")
    assert has(12, "primeira linha deve ser EM") and has(12, "encontrado: 0") and has(13, "encontrado: 2")
    status = {r.filing_id: r.valido for r in N.filing_status(lines(spark, *files)).collect()}
    assert status["F1"] and not status["F0"]
    with pytest.raises(ValueError):
        bad = lines(spark, files[0])
        N.require_valid(N.filing_status(bad), N.top_messages(bad))


def test_slices_match_whole_filing(spark):
    """Running totals and owners over tiny slices equal a plain pass over the filing."""
    rnd = random.Random(7)
    rows = [(f"F{i % 3}", n * rnd.choice([1, 1, 50]) + n * 100, rnd.randint(0, 4)) for i in range(3) for n in range(200)]
    df = spark.createDataFrame(rows, "g string, o bigint, x int")
    got = {(r.g, r.o): r.t for r in ordered.running_total(df, ["g"], "o", df.x, "t", rows=7).collect()}
    for g in {r[0] for r in rows}:
        total = 0
        for _, o, x in sorted(r for r in rows if r[0] == g):
            total += x
            assert got[(g, o)] == total

    kinds = [rnd.choice(["EM", "TN", "TI", "CC", "PI"]) for _ in range(500)]
    text = lines(spark, [k + "x" for k in kinds])
    out = ordered.carry_last(
        N.with_type(text), ["filing_id"], "line_no",
        __import__("pyspark").sql.functions.expr("CASE WHEN tipo IN ('EM','TN','TI') THEN line_no END"), "own", rows=16)
    owner = None
    expect = {}
    for n, k in enumerate(kinds, 1):
        owner = n if k in ("EM", "TN", "TI") else owner
        expect[n] = owner
    assert {r.line_no: r.own for r in out.collect()} == expect


def test_dependencies_over_tiny_slices(spark):
    """Cross-line errors and verdicts equal a plain pass over each filing, wherever slices cut its segments."""
    rnd = random.Random(11)
    make = {"EM": lambda: EM, "TN": lambda: tn(pickup=rnd.choice("PA"), delivery=rnd.choice("PA")), "CC": cc,
            "TI": lambda: ti(rnd.choice("PA")), "PI": pi, "LR": lambda: sub("LR"), "LE": lambda: sub("LE"), "LA": lambda: sub("LA")}
    files = [[make[rnd.choice(list(make))]() for _ in range(size)] for size in (1, 2, 5, 40, 120)]
    files += [[EM] + [sub("LR")] * 20 + [tn(pickup="A")] + [cc()] * 20 + [sub("LR")] + [ti("A")] + [cc()] * 20 + [pi(), sub("LA")]]
    expect = []
    for i, rows in enumerate(files):
        add = lambda no, tipo, text, i=i: expect.append((f"F{i}", no, tipo, text))
        if rows[0][:2] != "EM":
            add(1, rows[0][:2], "primeira linha deve ser EM.")
        heads = sum(r[:2] == "EM" for r in rows)
        if heads != 1:
            add(1, "EM", f"arquivo deve conter exatamente 1 linha EM, encontrado: {heads}.")
        owner, has, need = None, set(), set()
        for no, row in enumerate([*rows, "EM"], 1):
            kind = row[:2]
            if kind in N.MAIN_TYPES:
                for k in sorted(need - has):
                    add(owner[0], owner[1], N.SEGMENT_MESSAGE[k])
                owner, has, need = (no, kind), set(), set()
                if kind == "TN":
                    need = {k for k, at in (("LR", 274), ("LE", 275)) if row[at] == "A"}
                elif kind == "TI":
                    need = {"PI"} | ({"LA"} if row[108] == "A" else set())
            has.add(kind)
            if kind in ("PI", "LA") and (owner is None or owner[1] != "TI"):
                add(no, kind, f"subsecao {kind} deve estar vinculada a uma linha TI anterior.")
    df = lines(spark, *files)
    for rows in (3, ordered.SLICE_ROWS):
        got = N.dependency_errors(df, rows=rows).select("filing_id", "line_no", "tipo", "mensagem").collect()
        assert sorted(map(tuple, got)) == sorted(expect)
    errors = [r.filing_id for r in N.all_errors(df).collect()]
    status = {r.filing_id: (r.total_linhas, r.n_erros, r.valido) for r in N.filing_status(df).collect()}
    assert status == {f"F{i}": (len(rows), errors.count(f"F{i}"), f"F{i}" not in errors) for i, rows in enumerate(files)}
    listed = spark.createDataFrame([("F0",), ("F9",)], "filing_id string")
    assert {r.filing_id: (r.total_linhas, r.n_erros) for r in N.filing_status(df, listed).collect()}["F9"] == (0, 1)


def test_read_files(spark, tmp_path):
    write(tmp_path / "bom.txt", b"\xef\xbb\xbf" + EM.encode() + b"\r\n" + tn().encode() + b"\n")
    write(tmp_path / "legacy.txt", "EM\nTN çã €\rX\n\nfim".encode("cp1252"))
    write(tmp_path / "utf8.txt", "EM\nTN çã\n".encode())
    checks = {r.path[-8:]: (r.bom, r.utf8, r.linhas) for r in S.file_checks(spark, str(tmp_path)).collect()}
    assert checks["/bom.txt"] == (True, True, 2)
    assert checks["utf8.txt"] == (False, True, 2)
    assert checks["gacy.txt"] == (False, False, 5)
    got = {}
    for r in S.read_filing_lines(spark, str(tmp_path)).orderBy("filing_id", "line_no").collect():
        got.setdefault(r.filing_id.rsplit("/", 1)[1], []).append((r.line_no, r.value))
    assert got["legacy.txt"] == [(1, "EM"), (2, "TN çã €"), (3, "X"), (4, ""), (5, "fim")]
    assert got["utf8.txt"] == [(1, "EM"), (2, "TN çã")]
    assert [v for _, v in got["bom.txt"]] == ["\ufeff" + EM, tn()]
    strict = S.read_filing_lines(spark, str(tmp_path), strict_utf8=True)
    assert strict.filter("filing_id like '%legacy%'").isEmpty()
    assert {r.mensagem[:20] for r in S.file_errors(S.file_checks(spark, str(tmp_path))).collect()} == {
        "arquivo possui BOM U", "Arquivo nao esta em "}


def test_file_split_over_blocks(spark, tmp_path):
    """Line numbers continue over the blocks of one large file."""
    n = 20000
    write(tmp_path / "big.txt", b"".join(b"TN%07d\n" % i for i in range(1, n + 1)))
    rows = S.read_filing_lines(spark, str(tmp_path), range_bytes=20_000).collect()
    assert len(rows) == n and all(int(r.value[2:]) == r.line_no for r in rows)


def test_segments_are_sorted_in_partitions_that_grow_with_the_lines(spark, monkeypatch):
    name, before, seen = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"), []
    monkeypatch.setattr(shared, "TASK_ROWS", 1)
    monkeypatch.setattr(N, "cut", lambda df: seen.append(int(spark.conf.get(name))) or shared.cut(df))
    df = lines(spark, [EM, tn(pickup="A"), cc(), sub("LR"), ti(), pi()])
    assert N.dependency_errors(df).count() == 0
    assert seen == [6] and spark.conf.get(name) == before


def test_a_line_is_padded_once_for_all_its_fields(spark):
    """Fields that pad for themselves cost several times as much."""
    df = spark.createDataFrame([("F1", 1, "TNx")], "filing_id string, line_no long, value string")
    out = N.parse_lines(df, "TN")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("rpad(") == 1
    assert out.first().local_entrega == ""


def test_what_generators_read_is_compiled(spark):
    """The rules are worked out in a projection; a generator's own input is interpreted."""
    lines = spark.createDataFrame([("F", 1, tn())], "filing_id string, line_no long, value string")
    plan = N.line_errors(lines)._jdf.queryExecution().optimizedPlan().toString()
    generate = [row for row in plan.splitlines() if "Generate " in row]
    assert len(generate) == 1 and "RLIKE" not in generate[0] and "substring" not in generate[0]
    assert plan.count("linha contem letras minusculas") == 1


def test_id_checks_on_numbers_equal_those_on_texts(spark):
    good = [A, B, P, "0" * 14, "1" * 14, "2" * 11, "", None, "1", "000" + P, "9" * 25]
    ids = good + [d[:i] + c + d[i + 1:] for d in (A, P) for i in range(len(d)) for c in "0123456789"]
    df = spark.createDataFrame([(d,) for d in ids], "d string").withColumn("n", D.number(F.col("d")))
    for size, text in ((14, D.is_valid_cnpj), (11, D.is_valid_cpf)):
        found = df.select(text("d").alias("a"), D.number_ok("d", "n", size).alias("b")).collect()
        assert [r.a for r in found] == [r.b for r in found] and sum(r.a for r in found) > 1


def test_line_end_at_the_end_is_a_control_character(spark):
    lines = spark.createDataFrame([("F", 1, cc() + "\n"), ("F", 2, cc())], "filing_id string, line_no long, value string")
    found = {r.line_no for r in N.line_errors(lines).collect() if "controle" in r.mensagem}
    assert found == {1}
