"""Every query with SQL agrees with DuckDB on whole tables."""

import os

import pytest

from compare import compare, connect
from diffgauge.plans.registry import load

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
PLANS, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    text, ok, _ = compare(PLANS[name], ORACLES[name], spark, con, FOLDER)
    assert ok, text


def test_names_and_ids():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    ids = {n.split("_")[0] for n in PLANS}
    want = ([f"A{i}" for i in range(1, 15)] + [f"B{i}" for i in range(1, 34)] + [f"C{i}" for i in range(1, 11)]
            + [f"D{i}" for i in range(1, 14)] + [f"E{i}" for i in range(1, 21)] + [f"F{i}" for i in range(1, 12)]
            + [f"G{i}" for i in range(1, 8)] + [f"H{i}" for i in range(1, 5)] + [f"I{i}" for i in range(1, 7)]
            + [f"J{i}" for i in range(1, 7)] + [f"K{i}" for i in range(1, 10)] + [f"L{i}" for i in range(1, 9)]
            + [f"M{i}" for i in range(1, 12)] + [f"N{i}" for i in range(1, 8)])
    assert not set(want) - ids
