"""Every query against its SQL twin, at the smallest scale."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from check_oracle import connect, difference

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(contract.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = contract.queries()[name](spark, SF_DIR)
    assert difference(got, duck.execute(contract.oracle_sql()[name])) is None


def test_entry(spark):
    assert contract.entry(spark).columns == ["user_id", "onset"]


def test_every_query_has_sql():
    assert set(contract.ORACLES) == set(contract.QUERIES)
