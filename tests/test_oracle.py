"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__
from __spark_entry__ import entry
from tidewrack.plans import ORACLES, QUERIES

from .oracle import DATA, compare, duck

SF = os.environ.get("TEST_SF", "sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(f"{DATA}/{SF}")


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    assert compare(spark, con, QUERIES[key], ORACLES[key], f"{DATA}/{SF}") is None


def test_every_query_is_registered():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= __spark_entry__.queries().keys()
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["site", "year", "month", "date", "var", "ref", "anom", "sign"]
    assert df.count() > 0
