"""Counters, histograms, gauges and replication lag from the probe log."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions import error_kind, op_status, parse_value
from fleetpulse.operators.ordered import Look, look, previous
from fleetpulse.operators.sizing import written
from fleetpulse.sources.driver_tables import nanos

ORDER = ["ts", "seq"]

# The finite upper bounds of the latency histogram, in seconds.
BOUNDS = [0.0005 * 2**i for i in range(12)]
INFINITY = float("inf")


def op_counts(log: DataFrame) -> DataFrame:
    """Operations by cluster, role, follower (follower reads only) and status."""
    status = op_status(F.col("err"), F.col("net_timeout"))
    return log.groupBy("cluster", "role", _replica().alias("replica"), status.alias("status")).agg(
        F.count("*").alias("ops")
    )


def error_counts(log: DataFrame) -> DataFrame:
    """Errors by cluster, role, follower (follower reads only) and kind."""
    kind = error_kind(F.col("err"), F.col("net_timeout"))
    return (
        log.select("cluster", "role", _replica().alias("replica"), kind.alias("kind"))
        .where(F.col("kind").isNotNull())
        .groupBy("cluster", "role", "replica", "kind")
        .agg(F.count("*").alias("errors"))
    )


def _replica() -> Column:
    return F.when(F.col("role") == "replica_read", F.col("replica"))


def _bucket_counts(log: DataFrame) -> DataFrame:
    """One row per label tuple with a count for each bound. Errors are included."""
    counts = [F.count_if(F.col("dur_s") <= b).alias(f"_le{i}") for i, b in enumerate(BOUNDS)]
    return log.groupBy("cluster", "role", _replica().alias("replica")).agg(
        *counts, F.count("dur_s").alias("count"), F.sum("dur_s").alias("sum")
    )


def _buckets() -> list[tuple[float, Column]]:
    finite = [(b, F.col(f"_le{i}")) for i, b in enumerate(BOUNDS)]
    return [*finite, (INFINITY, F.col("count"))]


def latency_histogram(log: DataFrame) -> DataFrame:
    """Cumulative counts per latency bound in long form, with each label tuple's sum and count.

    The last bound is infinity. The bounds are aggregates of one pass, never a join. Works on
    streams too.
    """
    rows = F.array(*[F.struct(F.lit(b).alias("le"), n.alias("cum")) for b, n in _buckets()])
    return _bucket_counts(log).select("cluster", "role", "replica", F.inline(rows), "count", "sum")


def reads_of(log: DataFrame) -> DataFrame:
    """Reads that returned something, whether or not it parses."""
    return log.where(F.col("role").isin("master_read", "replica_read") & F.col("err").isNull())


def with_value(log: DataFrame) -> DataFrame:
    """Reads with a value that parses, with `n`, `written_at_ns` and the age in nanoseconds.

    The age is from the original write to the completion of the read; its sign is kept.
    """
    value = parse_value(F.col("raw"))
    return (
        reads_of(log).select("seq", "ts", "cluster", "role", "replica", value.alias("value"))
        .where(F.col("value").isNotNull())
        .select("seq", "ts", "cluster", "role", "replica", "value.*")
        .withColumn("age_ns", F.try_subtract(nanos(F.col("ts")), F.col("written_at_ns")))
    )


def latest(df: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """The values of the last row per key, with its order columns, which make a row unique."""
    if len(order) == 1:
        # One instant has one row, and plain columns are aggregated by hashing, without a sort.
        last = [F.max_by(c, order[0]).alias(c) for c in values]
        return df.groupBy(*keys).agg(F.max(order[0]).alias(order[0]), *last)
    last = F.max(F.struct(*order, *values))
    return df.groupBy(*keys).agg(last.alias("_last")).select(*keys, "_last.*")


def value_gauges(log: DataFrame) -> DataFrame:
    """The latest value and age: one row per cluster's leader and per follower."""
    reads = with_value(log).withColumn("replica", _replica())
    return latest(reads, ["cluster", "role", "replica"], ["n", "age_ns"], ORDER)


def value_age(log: DataFrame) -> DataFrame:
    """The age of the value each read returned."""
    return with_value(log).select(
        "seq", "cluster", "role", _replica().alias("replica"), "n", "age_ns"
    )


def _with_leader(log: DataFrame, column: str) -> DataFrame:
    """Follower reads with a column of the last leader read before as struct `leader`, if any."""
    leader = F.when(F.col("role") == "master_read", F.struct(column))
    rows = look(with_value(log), ["cluster"], ORDER, Look("leader", leader), measure=reads_of(log))
    return rows.where(F.col("role") == "replica_read")


def replica_lag(log: DataFrame) -> DataFrame:
    """Writes each follower read was behind the last leader read completed before it.

    No row while no leader value above 0 is known. A negative lag is kept. The last leader value
    counts, not the highest: it falls after a failover that lost writes.
    """
    return _with_leader(log, "n").where(F.col("leader.n") > 0).select(
        "seq", "ts", "cluster", "replica",
        F.try_subtract(F.col("leader.n"), F.col("n")).alias("lag"),
    )


def lag_gauge(log: DataFrame) -> DataFrame:
    """The latest lag per follower."""
    return latest(replica_lag(log), ["cluster", "replica"], ["lag"], ORDER)


def gauges_with_lag(log: DataFrame) -> DataFrame:
    """The gauges of `value_gauges` and, where there is one, the lag of `lag_gauge`, from one order of the
    reads: a row per cluster, role and follower."""
    leader = F.when(F.col("role") == "master_read", F.struct("n"))
    rows = look(with_value(log), ["cluster"], ORDER, Look("leader", leader), measure=reads_of(log))
    behind = F.struct(*ORDER, F.try_subtract(F.col("leader.n"), F.col("n")).alias("lag"))
    lagging = (F.col("role") == "replica_read") & (F.col("leader.n") > 0)
    return rows.groupBy("cluster", "role", _replica().alias("replica")).agg(
        F.max(F.struct(*ORDER, "n", "age_ns")).alias("_last"), F.max(F.when(lagging, behind)).alias("_lag")
    ).select("cluster", "role", "replica", "_last.n", "_last.age_ns", F.col("_lag").isNotNull().alias("lags"), "_lag.lag")


def age_gap(log: DataFrame) -> DataFrame:
    """How much older a follower's value was than the leader's last seen one, per follower read."""
    return _with_leader(log, "age_ns").where(F.col("leader").isNotNull()).select(
        "seq", "ts", "cluster", "replica", "age_ns",
        F.col("leader.age_ns").alias("leader_age_ns"),
        F.try_subtract(F.col("age_ns"), F.col("leader.age_ns")).alias("gap_ns"),
    )


def _leader_steps(log: DataFrame) -> DataFrame:
    log = log.where(F.col("role") == "master_read")
    steps = previous(with_value(log), ["cluster"], ORDER, ["n", "age_ns", "ts"], measure=reads_of(log))
    return steps.where(F.col("prev").isNotNull())


def stalls(log: DataFrame, min_age_ns: int) -> DataFrame:
    """Leader reads that return the same value as the read before, older by now than `min_age_ns`."""
    steps = _leader_steps(log)
    return steps.where(
        (F.col("n") == F.col("prev.n"))
        & (F.col("age_ns") > F.col("prev.age_ns"))
        & (F.col("age_ns") >= min_age_ns)
    ).select("seq", "ts", "cluster", "n", "age_ns")


def regressions(log: DataFrame) -> DataFrame:
    """Leader reads whose value fell (lost writes) or skipped since the read before."""
    step = F.try_subtract(F.col("n"), F.col("prev.n"))
    return (
        _leader_steps(log)
        .withColumn("step", step)
        .where((F.col("step") < 0) | (F.col("step") > 1))
        .select(
            "seq", "ts", "cluster", F.col("prev.n").alias("prev_n"), "n",
            F.when(F.col("step") < 0, "fell").otherwise("skipped").alias("change"),
        )
    )


# -- the followers a probe reads, from coordinators' refreshes ---------------------------------


def with_ord(followers: DataFrame) -> DataFrame:
    """Rows without the coordinator's place `ord` are one coordinator's."""
    return followers if "ord" in followers.columns else followers.withColumn("ord", F.lit(0))


def refreshes(followers: DataFrame) -> DataFrame:
    """Good refreshes as distinct (cluster, poll_ts, addr); `addr` is null for an empty list.

    A failed refresh leaves the set as it was, so it does not count. Of several coordinators' answers
    at one instant the first good one, by `ord`, is the refresh.
    """
    good = with_ord(followers).where("ok").select("cluster", "poll_ts", "ord", "addr").dropDuplicates()
    first = good.groupBy("cluster", "poll_ts").agg(F.min("ord").alias("ord"))
    return good.join(first, ["cluster", "poll_ts", "ord"]).select("cluster", "poll_ts", "addr")


def followers_observed(followers: DataFrame) -> DataFrame:
    """The number of distinct followers in each cluster's last good refresh."""
    per_refresh = refreshes(followers).groupBy("cluster", "poll_ts").agg(F.count("addr").alias("observed"))
    return latest(per_refresh, ["cluster"], ["observed"], ["poll_ts"])


def follower_changes(followers: DataFrame) -> DataFrame:
    """Followers that joined or left between a good refresh and the next, with the later's time.

    The refreshes are far smaller than the replies they come from and are needed twice, so they are
    written once. Each follower of a refresh is set down at its own time and at the next refresh's: one
    aggregation by follower and time tells who was there before, who is there, and who is both.
    """
    seen = written(refreshes(followers), "refreshes")
    rounds = look(
        seen.select("cluster", "poll_ts").distinct(), ["cluster"], ["poll_ts"],
        Look("next", F.struct("poll_ts"), inclusive=False, ahead=True),
    ).select("cluster", "poll_ts", F.col("next.poll_ts").alias("next_ts"))
    marks = F.array(
        F.struct(F.col("poll_ts").alias("ts"), F.lit(True).alias("here")),
        F.struct(F.col("next_ts").alias("ts"), F.lit(False).alias("here")),
    )
    listed = seen.where(F.col("addr").isNotNull()).join(rounds, ["cluster", "poll_ts"])
    at = listed.select("cluster", "addr", F.inline(marks)).where(F.col("ts").isNotNull())
    at = at.groupBy("cluster", "addr", "ts").agg(F.max("here").alias("here"), F.min("here").alias("joined"))
    change = F.when(~F.col("here"), "left").when(F.col("joined"), "joined")
    return at.select("cluster", "addr", "ts", change.alias("change")).where(F.col("change").isNotNull())


def vanished_followers(followers: DataFrame) -> DataFrame:
    """Followers of one good refresh that are not in the cluster's next good one."""
    left = follower_changes(followers).where(F.col("change") == "left")
    return left.select("cluster", "addr", F.col("ts").alias("gone_ts"))


def latest_present(
    gauges: DataFrame, gone: DataFrame, keys: list[str], values: list[str], order: list[str]
) -> DataFrame:
    """`latest` without the values set before a key's last removal (`gone`: keys, `gone_ts`)."""
    removed = gone.groupBy(*keys).agg(F.max("gone_ts").alias("gone_ts"))
    now = latest(gauges, keys, values, order)
    kept = now.join(removed, keys, "left")
    return kept.where(F.col("gone_ts").isNull() | (F.col(order[0]) > F.col("gone_ts"))).drop("gone_ts")


# -- metrics as one long table -------------------------------------------------------------------


def to_samples(df: DataFrame, metric: Column, labels: list[str], value: Column, ts: Column) -> DataFrame:
    """Rows as (metric, labels, ts, value); null labels are left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in labels])
    return df.select(
        metric.alias("metric"),
        F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("labels"),
        ts.alias("ts"),
        value.cast("double").alias("value"),
    )


def _counts_by_kind(log: DataFrame) -> DataFrame:
    """What all counters and histograms are sums of, in one pass: a row per label tuple and kind."""
    kind = error_kind(F.col("err"), F.col("net_timeout"))
    counts = [F.count_if(F.col("dur_s") <= b).alias(f"_le{i}") for i, b in enumerate(BOUNDS)]
    return log.groupBy("cluster", "role", _replica().alias("replica"), kind.alias("kind")).agg(
        F.count("*").alias("ops"), *counts, F.count("dur_s").alias("count"), F.sum("dur_s").alias("sum")
    )


def all_samples(log: DataFrame, ts: Column, prefix: str = "probe") -> DataFrame:
    """Every metric of the probe log at one instant, in long form.

    Counters and histograms come from one small table, gauges and lags from another, each written once:
    the log is read for each of the two, and once to count reads per hour.
    """

    def name(subject: Column | str, suffix: str) -> Column:
        return F.concat(F.lit(f"{prefix}_"), subject, F.lit(suffix))

    def several(*rows: tuple[Column, Column, Column | None]) -> Column:
        none = F.lit(None).cast("double")
        return F.inline(F.array(*[
            F.struct(m.alias("metric"), v.cast("double").alias("value"), (none if le is None else F.lit(le)).alias("le"))
            for m, v, le in rows
        ]))

    def samples(df: DataFrame, labels: list[str]) -> DataFrame:
        return to_samples(df, F.col("metric"), labels, F.col("value"), ts)

    duration = "_duration_seconds"
    histogram = [(name("role", f"{duration}_bucket"), n, b) for b, n in _buckets()]
    histogram += [(name("role", f"{duration}_{c}"), F.col(c), None) for c in ("sum", "count")]
    subject = F.when(F.col("role") == "master_read", "master").otherwise("replica")
    gauges = [(name(subject, "_value"), F.col("n"), None),
              (name(subject, "_value_age_seconds"), F.col("age_ns") / 1e9, None)]
    where = ["cluster", "replica"]
    base = written(_counts_by_kind(log), "counts")
    status = F.when(F.col("kind").isNull(), "ok").otherwise("error").alias("status")
    ops = base.groupBy("role", *where, status).agg(F.sum("ops").alias("ops"))
    errors = base.where(F.col("kind").isNotNull())
    whole = [c for c in base.columns if c.startswith("_le")] + ["count"]
    buckets = base.groupBy("role", *where).agg(
        *[F.sum(c).alias(c) for c in [*whole, "sum"]]
    )
    lasts = written(gauges_with_lag(log), "gauges")
    return (
        to_samples(ops, name("role", "s_total"), [*where, "status"], F.col("ops"), ts)
        .unionByName(to_samples(errors, name("role", "_errors_total"), [*where, "kind"], F.col("ops"), ts))
        .unionByName(samples(buckets.select(*where, several(*histogram)), [*where, "le"]))
        .unionByName(samples(lasts.select(*where, several(*gauges)), where))
        .unionByName(to_samples(lasts.where("lags"), F.lit(f"{prefix}_replica_lag_count"), where, F.col("lag"), ts))
    )


def observed_samples(followers: DataFrame, prefix: str = "probe") -> DataFrame:
    """The number of followers observed as a metric, at the time of each cluster's last refresh."""
    rows = followers_observed(followers)
    return to_samples(rows, F.lit(f"{prefix}_replicas_observed"), ["cluster"], F.col("observed"), F.col("poll_ts"))
