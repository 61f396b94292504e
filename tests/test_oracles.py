"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import pytest
from compare import compare, duck
from conftest import SF

import __spark_entry__ as entry
from attestlake.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, con, name):
    problem, count, _ = compare(spark, con, SF, name, QUERIES[name], SQL[name])
    assert problem is None
    assert count > 0 or name == "sch07_hit_order"


def test_entry_runs(spark):
    assert {"claim_id", "verdict"} <= set(entry.entry(spark).columns)
