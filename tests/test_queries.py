"""Every registered query runs; those with a SQL twin give the same rows."""

from __future__ import annotations

import pytest
from conftest import SMALL

import __spark_entry__ as entry
from check import compare, connect

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_twins_belong_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ours = QUERIES[name](spark, SMALL).toPandas()
    assert len(ours.columns) == len(set(ours.columns))
    if name in SQL:
        assert compare(ours, duck.execute(SQL[name]).df()) == ""
    else:
        assert len(ours) > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 3
