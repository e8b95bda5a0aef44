"""Derived inputs: the rows of the fixture SQL, from shuffles of keys only."""

import datetime

import pytest

from cargofile.plans import fixtures, inputs
from cargofile.sources import shared


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A few orders; one company, one person, one order and one line come twice, and some keys lead nowhere."""
    path = str(tmp_path_factory.mktemp("small"))
    days = [datetime.datetime(2020, 1 + i % 12, 1 + i % 28) for i in range(40)]
    orders = [(i, i % 7) for i in range(1, 40)] + [(5, 5), (41, None), (42, 99)]
    items = [(i, i * 3 % 11, i % 5, j, float(i), 1.5 * j, days[i]) for i in range(1, 40) for j in range(1, 1 + i % 4)]
    items += [items[3], (41, 1, 1, 1, 1.0, 1.0, days[1]), (42, 1, 1, 1, 1.0, 1.0, days[1]), (7, None, 1, 5, 1.0, 1.0, days[2]),
              (8, 1, None, 5, 1.0, 1.0, days[2]), (9, 1, 1, None, 1.0, 1.0, days[2]), (10, 1, 1, 6, 1.0, 1.0, None)]
    for name, rows, schema in (
            ("supplier", [(k, k % 3) for k in range(5)] + [(2, 2), (3, 1)], "s_suppkey long, s_nationkey int"),
            ("customer", [(k,) for k in range(7)] + [(4,)], "c_custkey long"),
            ("orders", orders, "o_orderkey long, o_custkey long"),
            ("lineitem", items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                                "l_extendedprice double, l_shipdate timestamp")):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


def straight(spark, path, ctes, select):
    sql = fixtures._for_engine(fixtures.with_ctes(ctes, select), "spark")
    names = [t for t in fixtures.TABLES if "{" + t + "}" in sql]
    return spark.sql(sql, **{t: spark.read.parquet(f"{path}/{t}.parquet") for t in names})


def counted(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("sent", [fixtures.SENT_COMPANIES, 0])
def test_rows_of_the_sql(spark, small, monkeypatch, sent):
    monkeypatch.setattr(fixtures, "SENT_COMPANIES", sent)
    inputs._stored.clear()
    assert counted(fixtures.freight(spark, small)) == counted(straight(spark, small, fixtures.FREIGHT, "select * from freight"))
    whole = straight(spark, small, fixtures.LINES, "select filing_id, line_no, value from lines").filter("filing_id is not null")
    assert counted(fixtures.lines(spark, small)) == counted(whole)
    inputs._stored.clear()


def test_texts_are_not_shuffled(spark, small):
    plan = fixtures.freight(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    plan = fixtures.lines(spark, small)._jdf.queryExecution().executedPlan()
    dealt = [line for line in plan.toString().split("\n") if "Exchange" in line]
    assert dealt and not any("value" in line or "linhas" in line for line in dealt)
    keys = fixtures.freight_keys(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "INDÚSTRIA" not in keys and "CLIENTE" not in keys


def test_shuffle_partitions_of_inputs_grow_with_the_rows(spark, small, monkeypatch):
    """All partitions asked for while an input is built and stored, and none of them afterwards."""
    name = "spark.sql.shuffle.partitions"
    before, seen = spark.conf.get(name), []
    monkeypatch.setattr(shared, "TASK_ROWS", 5)
    rows = spark.read.parquet(f"{small}/lineitem.parquet").count()

    def build(spark, sf):
        seen.append(int(spark.conf.get(name)))
        return spark.range(3)

    assert inputs.stored(spark, small, "probe", build).count() == 3
    assert seen == [-(-rows // 5)] and seen[0] > int(before) and spark.conf.get(name) == before
    with pytest.raises(ValueError):
        with shared.sized(spark, 10 ** 9):
            raise ValueError
    assert spark.conf.get(name) == before


def test_numbering_reads_line_counts_from_storage(spark, small):
    """Its passes must not work out every record's line count again."""
    assert "Union" not in fixtures.lines(spark, small)._jdf.queryExecution().optimizedPlan().toString()
