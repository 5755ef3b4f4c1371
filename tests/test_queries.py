"""Every registered query runs; those with SQL give its rows."""

import pytest

from sensorweave import queries as Q
from tests.oracle import connect, rows_of, rows_of_sql


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, sf_dir, con, name):
    columns, rows = rows_of(Q.QUERIES[name](spark, sf_dir))
    assert rows
    if name in Q.ORACLES:
        want_columns, want = rows_of_sql(con, Q.ORACLES[name])
        assert columns == want_columns
        assert rows == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
