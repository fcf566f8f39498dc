"""Every registered query equals its SQL in DuckDB on the given tables."""

import os

import pytest

from checks.compare import difference, duck
from checks.queries import oracle_sql, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not there")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equal(spark, con, name):
    assert difference(spark, con, SF_DIR, name) is None


def test_entry(spark):
    import __spark_entry__

    assert [r["section"] for r in __spark_entry__.entry(spark).collect()] == [
        "PLATFORM_OVERVIEW", "REGIONAL_OVERVIEW", "SCALE_OPPORTUNITIES", "TOP_ISSUES"]
