"""Every query of the core against its SQL, on the smallest tables."""

import pytest

from gridlens.plans import oracle, queries

from .helpers import table

QUERIES, SQL = queries.queries(), oracle.oracle_sql()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, duck, sf, name):
    got = QUERIES[name](spark, sf)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got.columns, got.collect()) == table(want.columns, want.fetchall())
