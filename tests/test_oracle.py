"""Every SQL-expressible query against the same question asked of DuckDB."""

import pytest

import __spark_entry__ as contract
from compare import connect, difference

ORACLE = contract.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert difference(contract.queries()[name](spark, sf_dir), con, ORACLE[name]) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0
