import pathlib

import pytest
from oracle import compare, connect

import __spark_entry__ as entry_module
from statloom.session import working

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
# the corpus queries have tests of their own; the others with a DuckDB text are all compared
NAMES = sorted(n for n in ORACLES if not n.startswith("op"))
# nothing in the smallest tables qualifies for the first three, a printed figure of the last sits on a rounding tie there
LARGER = {"network_month_coverage", "pressure_roll_forward", "cohort_young_adults", "figure_drift"}


@pytest.fixture(scope="module")
def con():
    if not pathlib.Path(SF).is_dir():
        pytest.skip("test tables are not here")
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in NAMES if n not in LARGER])
def test_query_equals_duckdb(spark, con, name):
    with working(spark):
        assert compare(spark, con, SF, name, QUERIES, ORACLES, digits=7) == ""


@pytest.mark.parametrize("name", sorted(LARGER))
def test_query_equals_duckdb_on_the_larger_tables(spark, con, name):
    sf = SF.replace("0.001", "0.01")
    with working(spark):
        assert compare(spark, connect(sf), sf, name, QUERIES, ORACLES, digits=7) == ""


def test_entry(spark):
    df = entry_module.entry(spark)
    assert "wmean" in df.columns
