"""Every named query gives the rows its SQL states."""

import pytest
from compare import connect, difference

from qaspark.plans import load_catalog

SF_DIR = "/root/testdata/sf0.001"
QUERIES, STATED = load_catalog()


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(STATED))
def test_rows_match(spark, db, name):
    assert difference(QUERIES[name](spark, SF_DIR), db, STATED[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(STATED)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
