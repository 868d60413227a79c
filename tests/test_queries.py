"""Every registered query against its SQL on another engine."""

import pytest

from compare import connect, difference, spark_rows, sql_rows

import __spark_entry__ as contract
from recuento.catalog import all_queries

SF = "/root/testdata/sf0.001"
CATALOG = all_queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, con, name):
    result = spark_rows(CATALOG[name].run(spark, SF))
    assert difference(result, sql_rows(con, CATALOG[name].sql)) is None
    assert result[1], "no rows"


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
