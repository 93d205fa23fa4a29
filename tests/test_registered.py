"""Every registered query against its SQL, on whole tables."""

import os

import pytest
from compare import mismatch, views

import __spark_entry__ as entry
from isobar import oracle, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return views(SF_DIR)


def test_each_query_has_sql():
    assert set(queries.queries()) == set(oracle.oracle_sql())
    assert set(queries.queries()) <= set(entry.queries())


def test_entry_has_the_daily_columns(spark):
    result = entry.entry(spark)
    assert len(result.columns) == 19
    assert result.count() == 150


@pytest.mark.parametrize(
    "name", ["weather_anomalies", "weather_anomalies_bootstrap", "high_water_delta",
             "city_orphans", "city_stats_merged", "payload_hourly"]
)
def test_matches_sql_without_broadcasts(spark, connection, name):
    """The way beyond the size that is broadcast: shuffled joins."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        actual = entry.queries()[name](spark, SF_DIR)
        assert "Broadcast" not in actual._jdf.queryExecution().executedPlan().toString()
        assert mismatch(actual, entry.oracle_sql()[name], connection) is None
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", list(queries.queries()))
def test_matches_sql(spark, connection, name):
    actual, sql = entry.queries()[name](spark, SF_DIR), entry.oracle_sql()[name]
    assert mismatch(actual, sql, connection) is None
