"""The registered queries: which operator runs on which logical table, with which arguments."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse import functions as fn
from fleetpulse.operators import convergence, lifecycle, probes, rates, relabel
from fleetpulse.operators import topology as topo
from fleetpulse.operators.sizing import scratch_path
from fleetpulse.plans import health, reports, waiting
from fleetpulse.sources import driver_tables as tables
from fleetpulse.sources import readers, writers
from fleetpulse.streaming import live, running, tail

QUERIES = {}

# The tables hold a month, so rates are taken over hours here.
WINDOW, STEP = "6h", "1h"


LOOK_BACK = "7d"


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(operator, column: str, places: int):
    """Two engines add doubles in different orders, so sums are compared to some places only."""
    return lambda *args, **kwargs: operator(*args, **kwargs).withColumn(column, F.round(column, places))


def on(source, name: str, operator, *args, **kwargs) -> None:
    """Register an operator that needs one logical table only."""
    QUERIES[name] = lambda spark, folder: operator(source(spark, folder), *args, **kwargs)


# -- probe log -----------------------------------------------------------------------------------

on(tables.probe_log, "op_counts", probes.op_counts)
on(tables.probe_log, "error_counts", probes.error_counts)
on(tables.probe_log, "latency_histogram", rounded(probes.latency_histogram, "sum", 6))
on(tables.probe_log, "value_gauges", probes.value_gauges)
on(tables.probe_log, "value_age", probes.value_age)
on(tables.probe_log, "replica_lag", probes.replica_lag)
on(tables.probe_log, "lag_by_follower", health.lag_by_follower)
on(tables.probe_log, "age_gap", probes.age_gap)
on(tables.probe_log, "age_by_follower", health.age_by_follower)
on(tables.slow_probe_log, "stalls", probes.stalls, 600_000_000_000)
on(tables.slow_probe_log, "regressions", probes.regressions)
on(tables.probe_log, "op_rate", rates.op_rate, ["cluster", "role"], WINDOW, STEP)


@query
def parse_values(spark: SparkSession, folder: str) -> DataFrame:
    value = fn.parse_value(F.col("raw"))
    rows = tables.probe_log(spark, folder).select("seq", value.alias("v"))
    return rows.select("seq", "v.n", "v.written_at_ns", fn.format_value(F.col("v.n"), F.col("v.written_at_ns")).alias("text"))


@query
def probe_metrics(spark: SparkSession, folder: str) -> DataFrame:
    samples = probes.all_samples(tables.probe_log(spark, folder), F.expr(tables.EPOCH))
    label = lambda name: F.try_element_at("labels", F.lit(name)).alias(name)
    return samples.select("metric", *[label(n) for n in ("cluster", "replica", "status", "kind")], "ts",
                          F.round("value", 6).alias("value"),
                          F.try_element_at("labels", F.lit("le")).cast("double").alias("le"))


@query
def latest_present(spark: SparkSession, folder: str) -> DataFrame:
    log = tables.probe_log(spark, folder)
    gone = log.where((F.col("role") == "replica_read") & (fn.error_kind(F.col("err"), F.col("net_timeout")) == "other"))
    gone = gone.select("cluster", "replica", F.col("ts").alias("gone_ts"))
    return probes.latest_present(probes.replica_lag(log), gone, ["cluster", "replica"], ["lag"], probes.ORDER)


# -- sampled metrics -----------------------------------------------------------------------------

for _name in ("writes_per_second", "leader_reads_per_second", "follower_reads_per_second",
              "failover_write_errors", "follower_read_errors"):
    on(tables.probe_samples, _name, rounded(getattr(health, _name), "rate", 8), WINDOW, STEP)
on(tables.probe_samples, "writes_per_second_between_samples",
   rounded(health.writes_per_second, "rate", 8), WINDOW, STEP, extrapolate=False)
for _name in ("nodes_up", "connected_clients", "memory_used", "database_keys", "link_up",
              "offset_lag", "nodes_up_of_version", "keys_by_cluster"):
    on(tables.exporter_samples, _name, getattr(health, _name), look_back=LOOK_BACK)
on(tables.exporter_samples, "commands_per_second", rounded(health.commands_per_second, "rate", 8), WINDOW, STEP)
on(tables.exporter_samples, "offset_lag_by_cluster", health.offset_lag, ["redis_cluster"], LOOK_BACK)
on(tables.exporter_samples, "retained_samples",
   lambda s: rates.retain(s, "2d").select("metric", "ts", "value"))


def _counter(spark, folder):
    return rates.promote(tables.exporter_samples(spark, folder), "redis_commands_processed_total", ["instance", "db"])


@query
def counter_increase(spark: SparkSession, folder: str) -> DataFrame:
    each = rates.increase(_counter(spark, folder), ["instance", rates.SERIES], "day")
    return rates.sum_by(each, ["instance"], "increase", ["ts"])


@query
def resampled(spark: SparkSession, folder: str) -> DataFrame:
    return rates.resample(_counter(spark, folder), ["instance", "db", rates.SERIES], "6h", "2d").drop(rates.SERIES)


@query
def matched_errors(spark: SparkSession, folder: str) -> DataFrame:
    series = rates.promote(tables.probe_samples(spark, folder), "probe_write_errors_total", ["workload_cluster", "kind"])
    kept = rates.match(series, "kind", "=~", "read.*|master_down|load")
    return rates.sum_by(kept.withColumnRenamed("workload_cluster", "cluster"), ["cluster", "kind"], "value")


@query
def stored_samples(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "samples")
    writers.write_samples(tables.exporter_samples(spark, folder), path)
    back = readers.read_samples(spark, path)
    return back.groupBy("metric", F.col("date").cast("string").alias("day")).agg(
        F.count("*").alias("samples"), F.sum("value").alias("total")
    )


# -- inventory and topology ----------------------------------------------------------------------


def _inventory(spark, folder):
    return topo.nodes(tables.node_labels(spark, folder))


on(_inventory, "inventory", lambda n: n.orderBy("port", "name"))
on(tables.node_labels, "node_lookup", topo.node_labelled, "node-7")
on(_inventory, "container_table", topo.container_table)
on(_inventory, "probe_containers", lambda n: topo.probes(n).select("name", "role_label", "role_order", "cluster", "port"))
on(_inventory, "cluster_instances", lambda n: topo.by_cluster(topo.data_plane(n), "c7").select("name", "role_label", "port"))
on(_inventory, "clusters", topo.clusters)
on(_inventory, "removal_preview", reports.removal_preview)
on(_inventory, "exporter_layout", reports.exporter_layout)
on(_inventory, "free_ports", topo.free_slots, ["cluster"], 6380, 6700, 3)
on(tables.node_snapshot, "cluster_counts", lambda n: topo.cluster_counts(topo.data_plane(n)))
on(tables.node_snapshot, "version_mix", lambda n: topo.version_mix(topo.data_plane(n)))
on(tables.node_snapshot, "any_v6", lambda n: topo.has_version(topo.data_plane(n), 6, ["cluster"]))
on(tables.node_snapshot, "quorum", lambda n: topo.quorum(topo.by_role(n, topo.COORDINATOR_ROLE)))
on(tables.node_snapshot, "quorum_by_cluster",
   lambda n: topo.quorum(topo.by_role(n, topo.COORDINATOR_ROLE), ["cluster"]))
on(tables.node_snapshot, "first_states", reports.first_states)


@query
def replication_reports(spark: SparkSession, folder: str) -> DataFrame:
    return topo.with_report(tables.node_snapshot(spark, folder)).select(
        "name", "report.*", fn.replication_target(F.col("report")).alias("target"),
        fn.is_synced(F.col("report"), 6380 + F.substring_index("cluster", "c", -1).cast("bigint")).alias("synced"),
    )


@query
def names(spark: SparkSession, folder: str) -> DataFrame:
    port, cluster = F.col("port"), F.col("cluster")
    return tables.node_snapshot(spark, folder).select(
        "name", fn.instance_name(cluster, port).alias("instance"), fn.coordinator_name(port).alias("coordinator"),
        fn.probe_name(cluster).alias("probe"), fn.addr(F.lit("10.0.0.1"), port).alias("addr"),
        fn.target_uri(F.col("name"), port).alias("uri"),
        fn.label_key(F.concat(F.lit("fleet."), F.replace("name", F.lit("-"), F.lit(".")))).alias("label"),
    )


@query
def port_ranges(spark: SparkSession, folder: str) -> DataFrame:
    o = F.col("o_orderkey")
    text = F.when(o % 17 == 0, F.concat(F.lit(" "), 6380 + o % 90, F.lit("-6500"))).otherwise(
        F.concat(6380 + o % 90, F.lit("-"), 6380 + F.col("o_custkey") % 150))
    rows = tables.table(spark, folder, "orders").select(o, fn.parse_port_range(text).alias("r"))
    return rows.select("o_orderkey", "r.lo", "r.hi")


@query
def durations(spark: SparkSession, folder: str) -> DataFrame:
    o = F.col("o_orderkey")
    units = F.array(*[F.lit(u) for u in ("ms", "s", "m", "h", "d", "x", "h30m")])
    text = F.concat(o % 90, F.get(units, (o % 7).cast("int")))
    return tables.table(spark, folder, "orders").select(o, fn.parse_duration(text).alias("seconds"))


def with_leaders(name: str, report, keep: list[str] | None = None) -> None:
    def run(spark, folder):
        out = report(tables.node_snapshot(spark, folder), tables.leaders_told(spark, folder))
        return out.select(*keep) if keep else out

    QUERIES[name] = run


with_leaders("instance_table", reports.instance_table)
with_leaders("instance_list", reports.instance_list)
with_leaders("live_roles", reports.live_roles)
with_leaders("rewire_plan", reports.rewire_plan)
with_leaders("promotion_plan", reports.promotion_plan)
with_leaders("isolation_plan", reports.isolation_plan)


def _states(spark, folder):
    return lifecycle.replay(tables.trigger_log(spark, folder))


@query
def cluster_status(spark: SparkSession, folder: str) -> DataFrame:
    return reports.cluster_status(
        tables.node_snapshot(spark, folder), tables.leaders_told(spark, folder), _states(spark, folder)
    )


@query
def cluster_list(spark: SparkSession, folder: str) -> DataFrame:
    return reports.cluster_list(
        tables.node_snapshot(spark, folder), tables.leaders_told(spark, folder), _states(spark, folder)
    )


# -- coordinators --------------------------------------------------------------------------------

on(tables.coordinator_view, "leader_answers",
   lambda v: topo.leader_answers(v).select("poll_ts", "ord", "cluster", "ok", "name", "ip", "port", "told"))
on(tables.coordinator_view, "followers", topo.followers)
on(tables.coordinator_view, "current_leader", topo.current_leader)
on(tables.coordinator_view, "masters_by_coordinator", topo.masters)
on(tables.coordinator_view, "discovered_masters", topo.discovered_masters)
on(tables.coordinator_view, "pick_leader", lambda v: topo.pick_leader(topo.discovered_masters(v), "c7"))
on(tables.coordinator_view, "leader_changes", convergence.leader_changes)
on(tables.coordinator_view, "followers_observed", lambda v: probes.followers_observed(topo.followers(v)))
on(tables.coordinator_view, "vanished_followers", lambda v: probes.vanished_followers(topo.followers(v)))
on(tables.coordinator_view, "follower_changes", lambda v: probes.follower_changes(topo.followers(v)))
on(tables.coordinator_view, "observed_samples",
   lambda v: probes.observed_samples(topo.followers(v)).withColumn("labels", F.col("labels")["cluster"]))


@query
def follower_addresses(spark: SparkSession, folder: str) -> DataFrame:
    rows = topo.followers(tables.coordinator_view(spark, folder))
    return rows.where(F.col("addr").isNotNull()).select("cluster", "addr").dropDuplicates()


@query
def visible_followers(spark: SparkSession, folder: str) -> DataFrame:
    expected = topo.data_plane(tables.node_snapshot(spark, folder)).select("cluster", "port", "name")
    return topo.visible(expected, tables.coordinator_view(spark, folder))


@query
def priority_convergence(spark: SparkSession, folder: str) -> DataFrame:
    view = tables.coordinator_view(spark, folder)
    return reports.priority_convergence(tables.node_snapshot(spark, folder), tables.leaders_told(spark, folder), view)


@query
def removal_check(spark: SparkSession, folder: str) -> DataFrame:
    return reports.removal_check(tables.node_snapshot(spark, folder), tables.coordinator_view(spark, folder))


def _joined(c: str):
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


@query
def registration_plan(spark: SparkSession, folder: str) -> DataFrame:
    view = tables.coordinator_view(spark, folder)
    plan = reports.registration_plan(_states(spark, folder), view, topo.coordinators(view))
    return plan.select("cluster", "leader_host", "leader_port", "skipped", "quorum", _joined("new_ports"), _joined("prior_ports"))


@query
def quorum_plan(spark: SparkSession, folder: str) -> DataFrame:
    view = tables.coordinator_view(spark, folder)
    return reports.quorum_plan(view, topo.coordinators(view)).select("cluster", "quorum", _joined("ports"))


# -- convergence ---------------------------------------------------------------------------------


@query
def time_to_write(spark: SparkSession, folder: str) -> DataFrame:
    log = tables.probe_log(spark, folder).where(F.col("role") == "write")
    status = fn.op_status(F.col("err"), F.col("net_timeout"))
    starts = log.where(status == "error").select("cluster", "ts", F.col("seq").alias("id"))
    return convergence.time_to(starts, log.where(status == "ok").select("cluster", "ts"), ["cluster"], "30m")


@query
def time_to_visible(spark: SparkSession, folder: str) -> DataFrame:
    o = F.col("o_orderkey")
    starts = tables.table(spark, folder, "orders").select(
        F.concat(F.lit("c"), o % 25).alias("cluster"),
        (6380 + o % 25 + 25 * (F.col("o_custkey") % 8)).alias("port"),
        tables.poll_time(o).alias("ts"), o.alias("id"),
    )
    return waiting.time_to_visible(starts, topo.followers(tables.coordinator_view(spark, folder)), "10m")


@query
def time_to_ready(spark: SparkSession, folder: str) -> DataFrame:
    return waiting.time_to_ready(tables.node_starts(spark, folder), tables.report_polls(spark, folder), "6h")


@query
def time_to_synced(spark: SparkSession, folder: str) -> DataFrame:
    return waiting.time_to_synced(tables.node_starts(spark, folder), tables.report_polls(spark, folder), "6h")


@query
def time_to_priorities(spark: SparkSession, folder: str) -> DataFrame:
    starts = tables.node_starts(spark, folder)
    leader = tables.leaders_told(spark, folder).select("cluster", F.substring_index("cluster", "c", -1).cast("bigint").alias("c"))
    pairs = F.array(*[F.struct((6380 + F.col("c") + 25 * i).alias("port"), F.lit(p).cast("bigint").alias("priority"))
                      for i, p in ((1, 100), (2, 1))])
    expected = leader.select("cluster", F.inline(pairs))
    view = topo.followers(tables.coordinator_view(spark, folder))
    return waiting.time_to_priorities(starts.select("cluster", "id", "ts"), expected, view, "6h")


@query
def failover_outcome(spark: SparkSession, folder: str) -> DataFrame:
    o = F.col("o_orderkey")
    requests = tables.table(spark, folder, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey") % 25).alias("cluster"), o.alias("id"),
        (tables.poll_time(o) + F.expr("INTERVAL 5 SECONDS")).alias("ts"),
    )
    nodes = topo.data_plane(tables.node_snapshot(spark, folder))
    return convergence.failover_outcome(requests, tables.coordinator_view(spark, folder), nodes, "10m")


def _intervals(spark, folder):
    changes = convergence.leader_changes(tables.coordinator_view(spark, folder))
    return convergence.leader_intervals(changes, tables.node_snapshot(spark, folder))


QUERIES["leader_intervals"] = _intervals


@query
def leader_commands(spark: SparkSession, folder: str) -> DataFrame:
    return convergence.leader_commands(tables.command_log(spark, folder), _intervals(spark, folder), apart=True)


# -- lifecycle -----------------------------------------------------------------------------------

QUERIES["state_replay"] = _states
on(_states, "lifecycle_progress", reports.lifecycle_progress)
on(_states, "next_step", reports.next_step)
on(_states, "not_ready", reports.not_ready)


@query
def state_upsert(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "states")
    writers.write_states(_states(spark, folder), path)
    stored = spark.read.schema("cluster string, state string").parquet(path)
    again = lifecycle.replay(tables.trigger_log(spark, folder), stored)
    return lifecycle.upsert_states(stored, again)


@query
def state_delete(spark: SparkSession, folder: str) -> DataFrame:
    states = _states(spark, folder)
    return lifecycle.drop_states(states, topo.clusters(tables.node_snapshot(spark, folder)))


def _state_files(spark, folder):
    path = scratch_path(spark, "state-files")
    writers.write_state_files(_states(spark, folder), path)
    return readers.read_states(spark, path)


QUERIES["stored_states"] = _state_files
on(_state_files, "stored_clusters", readers.state_clusters)


@query
def clusters_with_state(spark: SparkSession, folder: str) -> DataFrame:
    found = readers.state_clusters(tables.trigger_log(spark, folder))
    return lifecycle.with_state(found, _states(spark, folder))


@query
def derived_triggers(spark: SparkSession, folder: str) -> DataFrame:
    coordinators = topo.coordinators(tables.coordinator_view(spark, folder))
    return reports.derived_triggers(
        tables.node_snapshot(spark, folder), tables.leaders_told(spark, folder), coordinators, _states(spark, folder)
    )


# -- discovery -----------------------------------------------------------------------------------

on(tables.discovered_target, "scrape_targets", relabel.scrape_targets)


@query
def relabelled_targets(spark: SparkSession, folder: str) -> DataFrame:
    kept = relabel.relabel(tables.discovered_target(spark, folder), relabel.instance_rules())
    return kept.select(F.explode("labels").alias("label", "value")).groupBy("label").agg(
        F.count("*").alias("targets"), F.countDistinct("value").alias("values")
    )


# -- stored tables, read back ----------------------------------------------------------------------


@query
def stored_probe_log(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "probe-log")
    tables.probe_log(spark, folder).write.parquet(path)
    return probes.op_counts(readers.read_probe_log(spark, path))


@query
def stored_targets(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "targets")
    tables.discovered_target(spark, folder).write.parquet(path)
    # Only this job's targets are found by being under management.
    found = relabel.scrape_targets(readers.read_targets(spark, path)).where("job = 'redis-instances'")
    return found.groupBy("job", "redis_version_major").agg(F.count("*").alias("targets"))


@query
def version_groups(spark: SparkSession, folder: str) -> DataFrame:
    group = fn.version_group(F.col("version")).alias("version_group")
    return topo.data_plane(tables.node_snapshot(spark, folder)).groupBy("cluster", group).agg(F.count("*").alias("nodes"))


# -- streams: each runs over all there is, one file a batch, and stops -----------------------------

BATCHES = 3


def _run(spark: SparkSession, folder: str, sources: dict[str, str], start) -> str:
    """Lay tables out in parts that follow each other by an expression, and run a stream after each part: one
    batch per part, each from the checkpoint of the one before. `start` takes the streams and the
    folder of results, which is returned."""
    out, paths = scratch_path(spark, "stream"), {name: scratch_path(spark, f"files-{name}") for name in sources}
    given = {name: tables.table(spark, folder, name) for name in sources}
    shares = [k / BATCHES for k in range(1, BATCHES)]
    # The place in the order, and the places between parts; equal ones stay together.
    at = {name: F.expr(order).cast("double") for name, order in sources.items()}
    bounds = {name: [float("-inf"), *given[name].select(at[name].alias("at")).approxQuantile("at", shares, 0.01), float("inf")] for name in sources}
    for k in range(BATCHES):
        for name in sources:
            part = (at[name] > F.lit(bounds[name][k])) & (at[name] <= F.lit(bounds[name][k + 1]))
            given[name].where(part).write.mode("append").parquet(paths[name])
        start(*[spark.readStream.schema(given[name].schema).parquet(paths[name]) for name in sources], out).awaitTermination()
    return out


EVENTS, ORDERS, LINES = {"events": "event_id"}, {"orders": "o_orderkey"}, {"lineitem": "l_orderkey"}


@query
def stream_op_counts(spark: SparkSession, folder: str) -> DataFrame:
    start = lambda e, out: running.run_table(probes.op_counts(tables.probe_log_of(e)), out)
    return running.current(spark, _run(spark, folder, EVENTS, start))


@query
def stream_histogram(spark: SparkSession, folder: str) -> DataFrame:
    start = lambda e, out: running.run_table(probes.latency_histogram(tables.probe_log_of(e)), out)
    return running.current(spark, _run(spark, folder, EVENTS, start)).withColumn("sum", F.round("sum", 6))


@query
def stream_op_rate(spark: SparkSession, folder: str) -> DataFrame:
    start = lambda e, out: live.run_rate(tables.probe_log_of(e), ["cluster", "role"], out, STEP, "7d", "1d")
    return live.rate_now(spark, _run(spark, folder, EVENTS, start), WINDOW, STEP)


@query
def stream_lag(spark: SparkSession, folder: str) -> DataFrame:
    start = lambda e, out: running.run_steps(tables.probe_log_of(e), live.lag_step, out, live.LAG_STATE)
    return running.results(spark, _run(spark, folder, EVENTS, start)).drop("batch")


@query
def stream_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    start = lambda o, out: running.run_steps(tables.trigger_log_of(o), live.lifecycle_step, out, live.LIFECYCLE_STATE)
    return running.current(spark, _run(spark, folder, {"orders": "unix_micros(cast(o_orderdate AS timestamp))"}, start))


@query
def stream_follower_changes(spark: SparkSession, folder: str) -> DataFrame:
    def start(lines, out):
        return running.run_steps(topo.followers(tables.follower_polls_of(lines)), live.follower_step, out, live.FOLLOWER_STATE)

    return live.changes_now(spark, _run(spark, folder, LINES, start))


@query
def stream_leader_commands(spark: SparkSession, folder: str) -> DataFrame:
    def start(lines, orders, out):
        stream = tail.both(tables.command_log_of(lines), tables.leader_polls_of(orders))
        step = tail.follow_leader(lambda session: tables.node_snapshot(session, folder))
        return running.run_steps(stream, step, out, tail.TAIL_STATE)

    return tail.commands_now(spark, _run(spark, folder, {**LINES, **ORDERS}, start), _intervals(spark, folder))


@query
def stream_retained_samples(spark: SparkSession, folder: str) -> DataFrame:
    start = lambda e, out: live.run_retained(tables.exporter_samples_of(e), out, "2d")
    return live.retained(spark, _run(spark, folder, EVENTS, start), "2d").select("metric", "ts", "value")


def _command_lines(spark, folder):
    path = scratch_path(spark, "command-lines")
    writers.write_command_lines(tables.command_log(spark, folder), path)
    return path


@query
def stream_command_lines(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch_path(spark, "stream")
    lines = readers.read_command_lines(spark, _command_lines(spark, folder), stream=True, maxFilesPerTrigger=40)
    running.run_append(lines, out).awaitTermination()
    return running.results(spark, out).groupBy("cluster", "node").agg(F.count("*").alias("lines"), F.countDistinct("line").alias("distinct_lines"))


@query
def printed_commands(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch_path(spark, "stream")
    lines = readers.read_command_lines(spark, _command_lines(spark, folder), stream=True)
    writers.tail_commands(lines, "parquet", path=f"{out}/rows", checkpointLocation=f"{out}/checkpoint").awaitTermination()
    return running.results(spark, out).groupBy("line").agg(F.count("*").alias("times"))


@query
def stream_cadence(spark: SparkSession, folder: str) -> DataFrame:
    """Two parts of the log at the cadence of a probe: the query stays up, and says what it took at which tick."""
    path, out = scratch_path(spark, "files-events"), scratch_path(spark, "stream")
    events = tables.table(spark, folder, "events")
    half = F.col("event_id") % 2 == 0
    events.where(half).write.parquet(path)
    log = tables.probe_log_of(spark.readStream.schema(events.schema).parquet(path))
    running_query = running.run_steps(log, live.lag_step, out, live.LAG_STATE, cadence="probe")
    try:
        running_query.processAllAvailable()
        events.where(~half).write.mode("append").parquet(path)
        running_query.processAllAvailable()
        told = running.ticks(running_query)
    finally:
        running_query.stop()
    row = ("probe", running.CADENCE["probe"], len(told) >= 2, sum(t["rows"] for t in told))
    return spark.createDataFrame([row], "cadence string, every string, several_batches boolean, rows bigint")
