"""Every registered query against its SQL, and the contract of the entry module."""

import pytest
from oracle import compare, connect

import __spark_entry__ as contract

SQL = contract.oracle_sql()
QUERIES = contract.queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir).toArrow()
    assert compare(got, con.sql(SQL[name]).to_arrow_table()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_and_names(spark):
    assert set(SQL) <= set(QUERIES)
    assert contract.entry(spark).columns == ["version", "n", "w1", "w2"]
