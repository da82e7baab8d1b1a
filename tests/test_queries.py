"""Every registered query of the fleet operators against its SQL."""

import pytest

import __spark_entry__ as registered
from checks.compare import compare
from checks.oracle_sql import ORACLES
from checks.registered import QUERIES
from conftest import FOLDER


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(registered.queries()) and set(ORACLES) <= set(registered.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, ORACLES[name]) is None


def test_entry(spark):
    df = registered.entry(spark)
    assert df.columns[:2] == ["cluster", "replica"] and df.count() == 15


@pytest.mark.parametrize(
    "name",
    ["replica_lag", "age_gap", "stalls", "writes_per_second", "resampled", "state_replay", "time_to_write",
     "failover_outcome", "leader_changes", "leader_commands", "follower_changes", "instance_table", "stream_lag"],
)
@pytest.mark.parametrize("rows", [100, 12])
def test_same_rows_when_every_key_is_hot(spark, con, limits, name, rows):
    """Small limits: with 100 most keys are cut by the hour, with 12 rows by range."""
    limits(rowsPerTask=rows, foldRows=3, broadcastRows=5)
    assert compare(QUERIES[name](spark, FOLDER), con, ORACLES[name]) is None
