"""Registered queries equal their DuckDB oracle SQL on sf0.001 (all of them; the training-data operators have their own tests)."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from oracle_check import compare, duck

ALL = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", [k for k in ALL if not k.startswith("op")])
def test_query_matches_oracle(spark, con, key):
    sdf = entry.queries()[key](spark, SF_SMALL).toPandas()
    ddf = con.execute(entry.oracle_sql()[key]).df()
    ok, msg = compare(sdf, ddf)
    assert ok, msg


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["Risk_Level", "Customers"]
