"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry_module
from checks import QUERIES, SQL
from checks.compare import EMPTY, differences, open_tables
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return open_tables(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    # A filter may leave nothing of the smallest tables.
    assert differences(spark, con, SMALL, QUERIES[name], SQL[name]) in ("", EMPTY)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry_gives_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert not [n for n in QUERIES if re.fullmatch(r"op\d+.*", n) or "pipeline" in n]
