"""Every registered query with SQL agrees exactly with its independent DuckDB SQL (sf0.001)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from compare_oracle import compare, duck  # noqa: E402
from conftest import SF_SMALL  # noqa: E402
from lanescope.plans.registry import QUERIES  # noqa: E402

NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_analysis_has_an_oracle():
    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, SF_SMALL, name, E.queries()[name], E.oracle_sql()[name])
    assert r["status"] == "MATCH", r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[:2] == ["origin_warehouse", "shipment_count"]
    assert df.count() > 0
