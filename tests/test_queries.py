"""Every registered query against its SQL, and the entry point's contract."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from textloom.plans.oracle import ORACLE
from textloom.plans.queries import QUERIES
from tests.oracle import connect, differences


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, small, duck, name):
    df = queries()[name](spark, small)
    assert differences(df, duck, oracle_sql()[name]) == []


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_entry(spark, small):
    rows = entry(spark).collect()
    assert {r.lang for r in rows} == {"de", "en", "es", "fr"}
