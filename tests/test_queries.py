"""Registered queries against their SQL oracles on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracles import compare  # noqa: E402
from spikeframe import plans  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_every_query_has_an_oracle():
    assert set(plans.QUERIES) == set(plans.ORACLES)
    assert set(plans.QUERIES) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_oracle(spark, name):
    _, rows, verdict = compare(spark, FOLDER, name)
    assert verdict == "ok" and rows > 0
    spark.catalog.clearCache()
