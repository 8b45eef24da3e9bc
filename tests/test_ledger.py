import duckdb
import pytest
from oracle import compare

import __spark_entry__ as entry_module
from statloom.operators import ledger
from statloom.session import working

METRICS = """unit long, year int, general_expenditure_usd long, education_usd long, county_like_functions_usd long, police_intergov_usd long, police_usd long,
 police_pct_core double, fire_usd long, fire_intergov_usd long, record_complete boolean, unit_imputed_share double, police_flags string, fire_flags string"""
ISSUES = "unit long, year int, status string, finding string"


def notes(spark, units, issues):
    plain = [(u, 1996, 100, 0, 0, 0, 50, 50.0, 20, 0, True, 0.0, "R", "R") for u in units]
    out = ledger.comparability(spark.createDataFrame(plain, METRICS), spark.createDataFrame(issues, ISSUES))
    return {r.unit: r.note for r in out.collect()}


def test_a_note_lists_every_issue(spark):
    many = [(1, 1996, "possible", f"order {i}. see books") for i in range(60)]
    odd = [(1, 1996, "verified", "late"), (1, 1996, "verified", "late"), (1, 1996, "verified", None), (2, 1996, None, "ab"), (2, 1996, None, "ab!"), (2, 1997, None, "other year"), (3, 1996, "verified", None), (None, 1996, None, "no unit")]
    got = notes(spark, [1, 2, 3, 4], many + odd)
    assert got[1].split("; ") == sorted(f"possible issue: order {i}" for i in range(60)) + ["verified issue: late"] * 2
    assert got == {1: got[1], 2: "possible issue: ab; possible issue: ab!", 3: "", 4: ""}


def test_the_list_of_a_hot_record_is_cut_and_joined_in_order(spark):
    many = [(1, 1996, "possible", f"{i * 7919 % 4000}{'!' * (i % 3)}") for i in range(4000)] * 2
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stretches = ledger.issue_lists(spark.createDataFrame(many, ISSUES)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(stretches) == 1 and len(stretches[0]["_issues"]) > 1
    assert "; ".join(stretches[0]["_issues"]).split("; ") == sorted(f"possible issue: {f}" for _, _, _, f in many)


@pytest.fixture(scope="module")
def busy_unit(tmp_path_factory):
    """Four suppliers over three years; unit 1 has 75 issues in its last one, five of them twice."""
    folder = tmp_path_factory.mktemp("busy")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    line = "l_orderkey::BIGINT AS l_orderkey, 1::BIGINT AS l_partkey, l_suppkey::BIGINT AS l_suppkey, l_linenumber::INT AS l_linenumber, l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice, l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax, l_returnflag, l_linestatus, l_shipdate"
    rows = """SELECT i AS l_orderkey, i % 4 + 1 AS l_suppkey, i // 4 % 7 + 1 AS l_linenumber, i % 13 + i % 4 * 5 + 1 AS l_quantity, i * 37 % 991 + 100 AS l_extendedprice, 0.05 AS l_discount, i % 9 / 100 AS l_tax,
      ['A', 'N', 'R'][i % 3 + 1] AS l_returnflag, ['F', 'O'][i % 2 + 1] AS l_linestatus, TIMESTAMP '1994-01-01' + INTERVAL (i % 1090) DAY AS l_shipdate FROM (SELECT range AS i FROM range(1500)) AS r"""
    busy = """SELECT 2000 + i % 70, 1, i % 7 + 1, 50, 100 + i, 0.1, CASE WHEN i % 70 < 20 THEN 0.08 ELSE 0.02 END, 'N', 'O', TIMESTAMP '1996-05-05' FROM (SELECT range AS i FROM range(75)) AS r"""
    tables = {
        "lineitem": f"SELECT {line} FROM ({rows} UNION ALL {busy}) AS q",
        "supplier": "SELECT range::BIGINT AS s_suppkey, 'SUPPLIER#' || range AS s_name, range::INT AS s_nationkey, 2500.0 * range - 3000 AS s_acctbal FROM range(1, 5)",
        "nation": "SELECT range::INT AS n_nationkey, 'NATION_' || range AS n_name, (range % 3)::INT AS n_regionkey FROM range(6)",
        "customer": "SELECT range::BIGINT AS c_custkey, 'CUSTOMER#' || range AS c_name, (range % 6)::INT AS c_nationkey, 10.0 * range AS c_acctbal, 'BUILDING' AS c_mktsegment FROM range(40)",
        "orders": "SELECT range::BIGINT AS o_orderkey, (range % 40)::BIGINT AS o_custkey, 'O' AS o_orderstatus, 5.0 * range AS o_totalprice, TIMESTAMP '1994-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(2100)",
    }
    for name, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), con


@pytest.mark.parametrize(("name", "column"), [("ledger_comparability_notes", "note"), ("city_bundle_export", "flags")])
def test_a_busy_record_keeps_its_whole_note(spark, busy_unit, name, column):
    folder, con = busy_unit
    oracles = entry_module.oracle_sql()
    found = con.execute(f"SELECT {column} FROM ({oracles[name]}) AS t").fetchall()
    assert max((note or "").count(" issue: ") for (note,) in found) == 75
    with working(spark):
        assert compare(spark, con, folder, name, entry_module.queries(), oracles, digits=7) == ""
