"""Live metrics, lag, states, follower sets and retained samples."""

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.functions.numbers import seconds
from fleetpulse.operators import probes, rates
from fleetpulse.operators.lifecycle import replay, upsert_states
from fleetpulse.operators.ordered import Look, look
from fleetpulse.operators.sizing import at_path, lookup_join, written
from fleetpulse.sources import schemas
from fleetpulse.streaming import running, steps

LAG_STATE = "cluster string, ts timestamp_ntz, seq bigint, n bigint"
LIFECYCLE_STATE = "cluster string, state string"
REPLY = ["cluster", "poll_ts", "ord", "addr", "ok"]
FOLLOWER_STATE = "cluster string, poll_ts timestamp_ntz, ord int, addr string, ok boolean, closed boolean"


def run_rate(
    log: DataFrame, keys: list, path: str, step: str = "15s", span: str = "1h", lateness: str = "10m", cadence: str | None = None
):
    """Start counting operations per step under `path`, see `steps.run_counts`.

    A late row corrects its step's count, however late it is. `rate_now` gives the rates.
    """
    return steps.run_counts(log, keys, path, step, span, lateness, cadence)


def rate_now(spark: SparkSession, path: str, window: str = "1m", step: str = "15s", since: str | None = None, span: str = "1h") -> DataFrame:
    """Operations per second over ``(t - window, t]`` of all rows so far, as `rates.op_rate` has it; with
    `since`, from that time on, for which only the folders of these ranges and the window before are read."""
    if since is None:
        return rates.rate_of_counts(steps.counts_now(spark, path), window, step)
    before = datetime.fromisoformat(since) - timedelta(seconds=seconds(window))
    counts = steps.counts_now(spark, path, before.isoformat(), span)
    return rates.rate_of_counts(counts, window, step).where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))


def lag_step(batch: DataFrame, leaders: DataFrame):
    """Lag of the batch's follower reads. State: the last leader read of each cluster.

    A read looks back within the batch first, then at the state. So the results are those of the
    whole log at once as long as batches follow each other in time; a row that comes later than
    its batch is compared with a newer leader value.
    """
    reads = probes.with_value(batch)
    leader = F.when(F.col("role") == "master_read", F.struct("n"))
    rows = look(reads, ["cluster"], probes.ORDER, Look("leader", leader), measure=probes.reads_of(batch))
    rows = rows.where(F.col("role") == "replica_read")
    rows = lookup_join(rows, leaders.select("cluster", F.col("n").alias("leader_before")), "cluster", "left")
    rows = rows.withColumn("leader_n", F.coalesce("leader.n", "leader_before")).where(F.col("leader_n") > 0)
    lag = F.try_subtract(F.col("leader_n"), F.col("n"))
    seen = reads.where(F.col("role") == "master_read").select("cluster", "ts", "seq", "n")
    after = probes.latest(seen.unionByName(leaders), ["cluster"], ["n"], probes.ORDER)
    return rows.select("seq", "ts", "cluster", "replica", lag.alias("lag")), after


def lifecycle_step(batch: DataFrame, states: DataFrame):
    """States of the clusters with triggers in the batch. State: every cluster's state."""
    changed = replay(batch, states)
    return changed, upsert_states(states, changed)


def _changes_after(sets: DataFrame, later: DataFrame) -> DataFrame:
    """What joined or left in refreshes `later` than the one that `sets` holds for each cluster."""
    both = later.select(*REPLY).unionByName(sets.select(*REPLY))
    # The set itself has no refresh before it here; its members joined earlier.
    old = sets.select("cluster", F.col("poll_ts").alias("ts")).distinct().withColumn("change", F.lit("joined"))
    return probes.follower_changes(both).join(old, ["cluster", "ts", "change"], "left_anti")


def follower_step(batch: DataFrame, sets: DataFrame):
    """Followers that joined or left a cluster's set.

    The replies of a refresh may come in several batches, so a cluster's newest refresh stays open
    until a reply of a later one comes; `changes_now` counts it in. A refresh that failed changes
    nothing; an empty one is kept as a row without address. Replies to a refresh no later than one
    that is closed come too late to count.

    State: the set of the last good closed refresh (`closed`), and the replies of the open one.
    """
    shut = sets.where("closed")
    before = shut.groupBy("cluster").agg(F.max("poll_ts").alias("shut_ts"))
    seen = probes.with_ord(batch).select(*REPLY).unionByName(sets.where("not closed").select(*REPLY)).dropDuplicates()
    seen = seen.join(before, "cluster", "left").where(F.col("shut_ts").isNull() | (F.col("poll_ts") > F.col("shut_ts")))
    newest = seen.groupBy("cluster").agg(F.max("poll_ts").alias("newest"))
    seen = written(seen.join(newest, "cluster").select(*REPLY, "newest"), "replies")
    whole = seen.where(F.col("poll_ts") < F.col("newest"))
    sets_now = probes.refreshes(whole.select(*REPLY).unionByName(shut.select(*REPLY)))
    last = sets_now.groupBy("cluster").agg(F.max("poll_ts").alias("poll_ts"))
    kept = sets_now.join(last, ["cluster", "poll_ts"], "left_semi").select(
        "cluster", "poll_ts", F.lit(0).alias("ord"), "addr", F.lit(True).alias("ok"), F.lit(True).alias("closed"))
    still = seen.where(F.col("poll_ts") == F.col("newest")).select(*REPLY, F.lit(False).alias("closed"))
    return _changes_after(shut, whole), kept.unionByName(still)


def changes_now(spark: SparkSession, path: str) -> DataFrame:
    """All changes of follower sets so far, those of the refreshes that are still open included."""
    sets = running.current(spark, path)
    return running.results(spark, path).drop("batch").unionByName(
        _changes_after(sets.where("closed"), sets.where("not closed")))


def sets_now(spark: SparkSession, path: str) -> DataFrame:
    """Each cluster's set in its last good refresh, be it open or closed."""
    seen = probes.refreshes(running.current(spark, path))
    last = seen.groupBy("cluster").agg(F.max("poll_ts").alias("poll_ts"))
    return seen.join(last, ["cluster", "poll_ts"], "left_semi")


def run_retained(samples: DataFrame, path: str, retention: str = "2h", cadence: str | None = None):
    """Start appending samples under `path`, by date and hour; hours out of date are deleted whole.

    What is kept is never written again. `retained` cuts at the exact time. A sample without time has no
    age and belongs to no hour: it is dropped."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.where(F.col("ts").isNotNull()).withColumns(
            {"date": F.to_date("ts"), "hour": F.hour("ts"), "batch": F.lit(batch_id).cast("bigint")})
        # A batch that is run again replaces its own files.
        rows.hint("rebalance", "date", "hour").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "hour", "batch").parquet(f"{path}/kept")
        dates = sorted(name for name in running.folders(spark, f"{path}/kept") if name.startswith("date="))
        if not dates:
            return
        newest = _kept(spark, path).where(F.col("date") == F.lit(dates[-1][5:]).cast("date")).agg(F.max("ts")).first()[0]
        oldest = newest - timedelta(seconds=float(seconds(retention)))
        for date in dates:
            for hour in running.folders(spark, f"{path}/kept/{date}"):
                end = datetime.fromisoformat(date[5:]) + timedelta(hours=int(hour.split("=")[1]) + 1)
                if end <= oldest:
                    files, place = at_path(spark, f"{path}/kept/{date}/{hour}")
                    files.delete(place, True)
            if not running.folders(spark, f"{path}/kept/{date}"):
                files, place = at_path(spark, f"{path}/kept/{date}")
                files.delete(place, True)

    writer = samples.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{path}/checkpoint")
    return running.every(writer, cadence).start()


def _kept(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{schemas.METRIC_SAMPLE}, date date, hour int, batch bigint").parquet(f"{path}/kept")


def retained(spark: SparkSession, path: str, retention: str = "2h") -> DataFrame:
    """The samples not older than `retention` by the latest one."""
    return rates.retain(_kept(spark, path), retention).drop("date", "hour", "batch")
