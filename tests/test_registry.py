"""Every registered query against its SQL, on the smallest given tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from looptrace.registry import queries as registered
from tests.compare import difference, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_of_the_library_has_sql():
    asked = set(entry.oracle_sql())
    assert set(registered.queries()) <= asked <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    assert difference(spark, con, name, FOLDER) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
