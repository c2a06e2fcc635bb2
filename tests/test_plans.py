"""Every registered query with a SQL twin must equal it on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck, read_duck, read_spark

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    got = read_spark(entry.queries()[name](spark, SF_DIR))
    assert compare(got, read_duck(con, ORACLES[name])) is None


def test_entry(spark):
    values = [r.value for r in sorted(entry.entry(spark).collect(), key=lambda r: r.k)]
    assert values and values == sorted(values) and 0 <= values[0] <= values[-1] <= 1


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())
