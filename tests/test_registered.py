"""Every registered query against its SQL on the smallest given tables."""

from __future__ import annotations

import pytest
from oracle import connect, difference

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_its_sql(spark, connection, name):
    result = queries()[name](spark, SF)
    if name in SQL:
        assert difference(result, connection, SQL[name]) is None
    else:
        assert result.count() > 0


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
