"""Every registered query against its reference SQL, on the smallest tables."""

import os
import sys

import pytest
from conftest import DATA

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import __spark_entry__ as entry_points  # noqa: E402
from check import compare, connect  # noqa: E402

from stepframe.plans.catalogue import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    result = compare(QUERIES[name](spark, DATA), con, ORACLES[name])
    assert result.startswith("ok"), result


def test_every_query_has_reference_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_all(spark):
    assert set(QUERIES) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
