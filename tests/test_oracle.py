"""Every query that has SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest

from crosslight.plans.queries import ORACLE, QUERIES

from .compare import DATA, connection, difference


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLE:
        assert not difference(spark, QUERIES[name], ORACLE[name], con)
    else:
        assert QUERIES[name](spark, str(DATA)).count() >= 0
