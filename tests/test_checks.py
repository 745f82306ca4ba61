"""Every registered query against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from telelake import checks
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(checks.queries()) == set(checks.oracle_sql())
    # What is registered beside them has tests of its own.
    assert set(checks.queries()) <= set(entry.queries()) and set(checks.oracle_sql()) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", checks.queries())
def test_query(spark, duck, name):
    assert difference(entry.queries()[name](spark, SF), duck, entry.oracle_sql()[name]) is None
