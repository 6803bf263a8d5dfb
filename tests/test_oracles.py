"""Every named query against its SQL oracle, on whole tables."""

import compare
import pytest
from conftest import TESTDATA

import __spark_entry__ as entry
from tickloom.oracles import ORACLES
from tickloom.registry import QUERIES

SF = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def db():
    return compare.connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    result = QUERIES[name](spark, SF)
    assert compare.difference(result, ORACLES[name], db) is None


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["symbol", "ts", "open", "high", "low", "close", "volume", "trades"]
    assert result.count() > 0
