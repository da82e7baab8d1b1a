"""What the physical plans must and must not hold."""

import contextlib
import io
from datetime import datetime

import pytest

from checks.registered import QUERIES
from fleetpulse.operators import convergence, probes, rates
from fleetpulse.plans import reports
from fleetpulse.sources import driver_tables, readers
from conftest import FOLDER


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "probe_log")
    driver_tables.probe_log(spark, FOLDER).write.parquet(path)
    return readers.read_probe_log(spark, path)


def test_filters_and_columns_reach_the_scan(log):
    plan = plan_of(probes.value_age(log))
    assert "PushedFilters: [In(role, [master_read,replica_read]), IsNull(err)" in plan
    assert "dur_s" not in plan and "net_timeout" not in plan


def test_counters_shuffle_once_after_partial_aggregation(log):
    plan = plan_of(probes.op_counts(log))
    assert plan.count(") Exchange") == 1 and "partial_count" in plan


def test_histogram_is_one_pass(log):
    plan = plan_of(probes.latency_histogram(log))
    assert plan.count("Scan parquet") == 2 and "Join" not in plan  # tree and details


def test_lag_is_one_shuffle(log):
    plan = plan_of(probes.replica_lag(log))
    assert plan.count(") Exchange") == 1 and "Join" not in plan


def test_rate_is_one_shuffle(spark):
    series = rates.promote(driver_tables.probe_samples(spark, FOLDER), "probe_writes_total", ["workload_cluster", "status"])
    plan = plan_of(rates.rate(series, ["workload_cluster", "status", rates.SERIES]))
    assert "Join" not in plan and plan.count(") Exchange") == 1


def test_rate_of_hot_series_groups_runs_in_place(spark, limits):
    limits(rowsPerTask=20)
    series = rates.promote(driver_tables.probe_samples(spark, FOLDER), "probe_writes_total", ["workload_cluster", "status"])
    plan = plan_of(rates.rate(series, ["workload_cluster", "status", rates.SERIES]))
    shuffles = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert not any("first#" in line for line in shuffles) and sum("_chunk#" in line for line in shuffles) >= 2


def test_few_intervals_leave_the_commands_where_they_are(spark, tmp_path):
    path = str(tmp_path / "commands")
    driver_tables.command_log(spark, FOLDER).write.parquet(path)
    schema = "cluster string, node string, from_ts timestamp_ntz, to_ts timestamp_ntz"
    few = spark.createDataFrame([("c1", "node-1", datetime(2024, 1, 1), None)], schema)
    plan = plan_of(convergence.leader_commands(readers.read_commands(spark, path), few))
    assert "BroadcastHashJoin" in plan and ") Exchange" not in plan


@pytest.mark.parametrize("rows, join", [(500_000, "BroadcastHashJoin"), (3, "SortMergeJoin")])
def test_small_sides_are_broadcast_by_their_count(spark, limits, rows, join):
    limits(broadcastRows=rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes, leaders = driver_tables.node_snapshot(spark, FOLDER), driver_tables.leaders_told(spark, FOLDER)
        assert join in plan_of(reports.instance_table(nodes, leaders))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


BATCH = [n for n in QUERIES if not n.startswith("stream_")]


@pytest.mark.parametrize("name", BATCH)
def test_no_pairs_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert word not in plan
