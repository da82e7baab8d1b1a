"""The documented health queries over sampled metrics and the probe log.

Each takes `metric_sample` rows (H4 and H5: the probe log). Rates are taken per series, carried on
to the window's edges unless `extrapolate` is false, and then summed by the labels of the answer.
`window` and `step` default to one minute and the evaluation interval; `prefix` is what the probes'
metric names start with, `cluster` the label that scraping puts on them. Queries of "now" take the
evaluation time `at` (default: the newest sample) and how far to look back from it.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.operators import probes, rates

NODE = ["instance", "redis_cluster"]


def _rate(samples, metric, labels, by, matcher, window, step, extrapolate) -> DataFrame:
    series = rates.promote(samples, metric, labels)
    if matcher:
        series = rates.match(series, *matcher)
    each = rates.rate(series, [*by, rates.SERIES], window, step, extrapolate)
    return rates.sum_by(each, by, "rate", ["ts"])


def _by_cluster(samples, metric, cluster, window, step, extrapolate) -> DataFrame:
    labels = [cluster, "status"]
    each = _rate(samples, metric, labels, labels, ("status", "=", "ok"), window, step, extrapolate)
    return each.withColumnRenamed(cluster, "cluster")


def writes_per_second(
    samples, window="1m", step="15s", prefix="probe", cluster="workload_cluster", extrapolate=True
) -> DataFrame:
    """H1: ok writes per second by cluster."""
    return _by_cluster(samples, f"{prefix}_writes_total", cluster, window, step, extrapolate)


def leader_reads_per_second(
    samples, window="1m", step="15s", prefix="probe", cluster="workload_cluster", extrapolate=True
) -> DataFrame:
    """H2: ok leader reads per second by cluster."""
    return _by_cluster(samples, f"{prefix}_master_reads_total", cluster, window, step, extrapolate)


def follower_reads_per_second(samples, window="1m", step="15s", prefix="probe", extrapolate=True) -> DataFrame:
    """H3: ok follower reads per second by follower."""
    return _rate(samples, f"{prefix}_replica_reads_total", ["replica", "status"], ["replica"],
                 ("status", "=", "ok"), window, step, extrapolate)


def lag_by_follower(log: DataFrame) -> DataFrame:
    """H4: writes behind, now, by follower."""
    return probes.lag_gauge(log)


def age_by_follower(log: DataFrame) -> DataFrame:
    """H5: age of the value each follower shows, beside the leader's and the gap between them."""
    gaps = probes.age_gap(log)
    return probes.latest(gaps, ["cluster", "replica"], ["age_ns", "leader_age_ns", "gap_ns"], probes.ORDER)


def failover_write_errors(samples, window="1m", step="15s", prefix="probe", extrapolate=True) -> DataFrame:
    """H6: write errors of the kinds a failover causes, per second by kind."""
    matcher = ("kind", "=~", "readonly|master_down|loading")
    return _rate(samples, f"{prefix}_write_errors_total", ["kind"], ["kind"], matcher, window, step, extrapolate)


def follower_read_errors(samples, window="1m", step="15s", prefix="probe", extrapolate=True) -> DataFrame:
    """H7: follower read errors per second by kind and follower."""
    by = ["kind", "replica"]
    return _rate(samples, f"{prefix}_replica_read_errors_total", by, by, None, window, step, extrapolate)


def nodes_up(samples, look_back="5m", at=None) -> DataFrame:
    """H8: 1 for each node that can be reached, else 0."""
    return rates.instant(samples, "redis_up", NODE, look_back, at)


def connected_clients(samples, look_back="5m", at=None) -> DataFrame:
    """H9: clients by node."""
    return rates.instant(samples, "redis_connected_clients", NODE, look_back, at)


def memory_used(samples, look_back="5m", at=None) -> DataFrame:
    """H10: memory by node."""
    return rates.instant(samples, "redis_memory_used_bytes", NODE, look_back, at)


def database_keys(samples, look_back="5m", at=None) -> DataFrame:
    """H11: keys per node and database."""
    return rates.instant(samples, "redis_db_keys", [*NODE, "db"], look_back, at)


def commands_per_second(samples, window="1m", step="15s", extrapolate=True) -> DataFrame:
    """H12: commands per second by node."""
    by = ["instance"]
    return _rate(samples, "redis_commands_processed_total", by, by, None, window, step, extrapolate)


def link_up(samples, look_back="5m", at=None) -> DataFrame:
    """H13: health of each node's replication link."""
    return rates.instant(samples, "redis_master_link_up", NODE, look_back, at)


def offset_lag(samples, on: list[str] | None = None, look_back="5m", at=None) -> DataFrame:
    """H14: leader offset minus follower offset: within equal label sets, or with `on` the leader's
    against each follower that has the same of these labels (`rates.subtract`)."""
    return rates.subtract(
        samples, "redis_master_repl_offset", "redis_slave_repl_offset", on, NODE, look_back, at)


def nodes_up_of_version(samples, major: str = "8", look_back="5m", at=None) -> DataFrame:
    """H15: nodes up, of one version only."""
    up = rates.instant(samples, "redis_up", [*NODE, "redis_version_major"], look_back, at)
    return rates.match(up, "redis_version_major", "=", major)


def keys_by_cluster(samples, look_back="5m", at=None) -> DataFrame:
    """H16: keys by cluster, summed over the value now of each series."""
    return rates.sum_by(database_keys(samples, look_back, at), ["redis_cluster"], "value")
