"""How long each awaited condition took, from starts (keys, `id`, `ts`) and the polls on it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions import is_synced, replication_state
from fleetpulse.operators.convergence import LIMITS, time_to
from fleetpulse.operators.probes import with_ord

NODE = ["cluster", "port"]


def _reports(polls: DataFrame, holds: Column) -> DataFrame:
    rows = polls.withColumn("report", replication_state(F.col("info_text")))
    return rows.where(holds).select(*NODE, F.col("poll_ts").alias("ts"))


def time_to_ready(starts: DataFrame, polls: DataFrame, limit: str = LIMITS["ready"]) -> DataFrame:
    """Until a node gives a report at all. `polls`: cluster, port, `poll_ts`, `info_text`."""
    return time_to(starts, _reports(polls, F.col("info_text").isNotNull()), NODE, limit)


def time_to_synced(starts: DataFrame, polls: DataFrame, limit: str = LIMITS["synced"]) -> DataFrame:
    """Until a node follows `leader_port`, a further column of `polls`, with the link up."""
    return time_to(starts, _reports(polls, is_synced(F.col("report"), F.col("leader_port"))), NODE, limit)


def _asked(good: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of the `rows` that the first coordinator told which gave a good reply at their poll."""
    first = good.groupBy("cluster", "poll_ts").agg(F.min("ord").alias("ord"))
    return rows.join(first, ["cluster", "poll_ts", "ord"], "left_semi")


def time_to_visible(starts: DataFrame, followers: DataFrame, limit: str = LIMITS["visible"]) -> DataFrame:
    """Until the coordinator that is asked lists a node's port; of several that answered at one poll, the
    first by `ord` is the one. `followers`: see `operators.topology.followers`."""
    rows = with_ord(followers).where("ok")
    seen = _asked(rows, rows.where(F.col("port").isNotNull()))
    return time_to(starts, seen.select(*NODE, F.col("poll_ts").alias("ts")), NODE, limit)


def time_to_priorities(
    starts: DataFrame, expected: DataFrame, followers: DataFrame, limit: str = LIMITS["priorities"]
) -> DataFrame:
    """Until the coordinator that is asked, as in `time_to_visible`, shows all of a cluster's expected
    (port, priority) pairs together. A cluster that expects none has not to wait.

    Where a reply lists a port more than once, a column `pos` of `followers` says which entry is the last,
    and that one counts; without the column any of them does."""
    pair = [*NODE, "priority"]
    expected = expected.select(*pair).dropDuplicates()
    wanted = expected.groupBy("cluster").agg(F.count("*").alias("wanted"))
    rows = with_ord(followers).where("ok")
    if "pos" in rows.columns:
        entries = rows.groupBy(*NODE, "poll_ts", "ord").agg(F.max_by("priority", "pos").alias("priority"))
    else:
        entries = rows.select("poll_ts", "ord", *pair).dropDuplicates()
    shown = _asked(rows, entries.join(expected, pair, "left_semi"))
    met = shown.groupBy("cluster", "poll_ts").agg(F.count("*").alias("met")).join(wanted, "cluster")
    polls = met.where(F.col("met") == F.col("wanted")).select("cluster", F.col("poll_ts").alias("ts"))
    at_once = starts.join(wanted, "cluster", "left_anti").select("cluster", "ts")
    return time_to(starts, polls.unionByName(at_once), ["cluster"], limit)
