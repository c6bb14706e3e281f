"""Every query of the library against its SQL over the same tables."""

from __future__ import annotations

import pytest
from compare import connect, difference

from tessera.plans import catalog

CALLS, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, sf_dir, name):
    assert difference(spark, con, sf_dir, CALLS[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(CALLS) - set(SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert CALLS[name](spark, sf_dir).count() > 0
