"""Every registered query against its SQL twin, on the smallest test tables."""

import pytest

from compare import compare, connect
from starwake.checks import load

FOLDER = "/root/testdata/sf0.001"
CHECKS = load()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_same_rows_as_sql(spark, con, name):
    problem = compare(spark, con, name, CHECKS[name], FOLDER)
    # Some reports are legitimately empty on the smallest tables.
    assert problem in (None, "no rows"), problem


def test_driver_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
