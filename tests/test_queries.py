"""Every registered query against its SQL twin, on the smallest tables."""

import pytest

from gridspark.queries import ORACLES, QUERIES
from tests.compare import compare, duck
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    msg, _ = compare(QUERIES[name](spark, SF), con, ORACLES[name])
    assert msg is None, msg


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).columns


def test_entry(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
