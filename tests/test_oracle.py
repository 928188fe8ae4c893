"""Every query with a statement gives the same rows in DuckDB; the others run."""

import oracle
import pytest

from spectrabatch.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = oracle.connect(sf_dir)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf_dir, con, name):
    assert oracle.differences(QUERIES[name](spark, sf_dir), ORACLES[name], con) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
