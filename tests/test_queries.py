"""Every query with SQL gives the SQL's rows; every other one runs."""

from __future__ import annotations

import pytest

from leafline import catalog
from tests.compare import connect, spark_rows, sql_rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, con, sf_dir, name):
    assert spark_rows(catalog.QUERIES[name](spark, sf_dir)) == sql_rows(con, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 9
    assert set(entry.oracle_sql()) <= set(entry.queries())
