"""Every registered query against DuckDB on the same tables."""

import pytest
from compare import duck, duck_result, spark_result
from conftest import SF

import __spark_entry__ as entry_point
from sensorframe.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    columns, rows = spark_result(entry_point.queries()[name](spark, SF))
    expected_columns, expected = duck_result(con, ORACLES[name])
    assert columns == expected_columns
    assert len(rows) == len(expected)
    assert rows == expected


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(ORACLES) <= set(entry_point.oracle_sql())


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["hour", "n"]
    assert df.count() > 0
