"""Fleet reports: the results of the operator's commands, for all clusters in one job."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions import (
    command_for,
    initial_state,
    is_chained,
    live_role,
    priority_for,
    replicating_from,
    replication_target,
    step_mark,
)
from fleetpulse.functions.lifecycle import EDGES, literal_map
from fleetpulse.operators import topology as topo
from fleetpulse.operators.lifecycle import STATES, allowed, state_order, with_state
from fleetpulse.operators.sizing import lookup_join

READY_FOR_V8 = ["V6Destroyed", "Done"]


# -- status --------------------------------------------------------------------------------------


def instance_table(nodes: DataFrame, leaders: DataFrame) -> DataFrame:
    """Name, live role, version, port, what it replicates from, and status of data-plane nodes.

    `leaders` holds (cluster, leader_port); a cluster without a row has no known leader.
    """
    rows = topo.with_report(topo.data_plane(nodes))
    known = lookup_join(rows, leaders.select("cluster", "leader_port"), "cluster", "left")
    leader = F.coalesce("leader_port", F.lit(0))
    report = F.col("report")
    return known.select(
        "cluster", "name",
        live_role(report, F.col("port"), leader).alias("role"),
        F.format_string("v%d", "version").alias("ver"),
        "port",
        F.coalesce(replicating_from(report), F.lit("-")).alias("replicating_from"),
        is_chained(report, leader).alias("chained"),
        "status",
    )


def live_roles(nodes: DataFrame, leaders: DataFrame) -> DataFrame:
    """Nodes per cluster and live role."""
    return instance_table(nodes, leaders).groupBy("cluster", "role").agg(F.count("*").alias("nodes"))


def instance_list(nodes: DataFrame, leaders: DataFrame, cluster: str | None = None) -> DataFrame:
    """The instance table of one cluster, or of all, in port order."""
    return instance_table(topo.by_cluster(nodes, cluster), leaders).orderBy("port")


def cluster_status(nodes: DataFrame, leaders: DataFrame, states: DataFrame) -> DataFrame:
    """The instance table with each cluster's state, allowed triggers and number of coordinators."""
    fleet = topo.by_role(nodes, topo.COORDINATOR_ROLE).agg(F.count("*"))
    rows = lookup_join(instance_table(nodes, leaders), states.select("cluster", "state"), "cluster", "left")
    state = F.coalesce("state", F.lit(STATES[0]))
    return rows.withColumn("state", state).withColumns(
        {"next_triggers": F.array_join(allowed(F.col("state")), ", "), "coordinators": fleet.scalar()}
    )


def cluster_list(nodes: DataFrame, leaders: DataFrame, states: DataFrame) -> DataFrame:
    """One row per cluster with data-plane nodes.

    The version is that of the node labelled leader at creation, or of the first node without one.
    """
    fleet = topo.by_role(nodes, topo.COORDINATOR_ROLE).agg(F.count("*"))
    first = F.struct(F.when(F.col("role_label") == "master", 0).otherwise(1), F.col("port"))
    rows = topo.data_plane(nodes).groupBy("cluster").agg(
        F.min_by("version", first).alias("version"), F.count("*").alias("instances")
    )
    rows = rows.join(leaders.select("cluster", "leader_port"), "cluster", "left")
    leader = F.coalesce(F.when(F.col("leader_port") > 0, F.col("leader_port").cast("string")), F.lit("-"))
    return with_state(rows, states).select(
        "cluster", "version", "instances", leader.alias("leader_port"),
        fleet.scalar().alias("coordinators"), "state",
    )


# -- plans for changes ---------------------------------------------------------------------------


def _facts(nodes: DataFrame, leaders: DataFrame) -> DataFrame:
    """Per cluster: leader port, the leader's node name if the inventory has it, versions present."""
    mix = topo.version_mix(nodes)
    named = leaders.select("cluster", "leader_port").join(
        nodes.select("cluster", F.col("port").alias("leader_port"), F.col("name").alias("leader_name")),
        ["cluster", "leader_port"], "left",
    )
    named = named.groupBy("cluster", "leader_port").agg(F.min("leader_name").alias("leader_name"))
    return mix.join(named, "cluster", "left")


def rewire_plan(nodes: DataFrame, leaders: DataFrame) -> DataFrame:
    """What to do with each data-plane node so that every follower follows the leader directly.

    ``rewire`` and ``direct`` followers, ``skipped`` ones that cannot be read, the ``leader``
    itself, and the clusters' errors: ``no leader``, or a ``leader without node``.
    """
    rows = topo.with_report(topo.data_plane(nodes))
    rows = lookup_join(rows, _facts(topo.data_plane(nodes), leaders), "cluster", "left")
    target = replication_target(F.col("report"))
    action = (
        F.when(F.coalesce("leader_port", F.lit(0)) == 0, "no leader")
        .when(F.col("leader_name").isNull(), "leader without node")
        .when(F.col("port") == F.col("leader_port"), "leader")
        .when(F.col("report").isNull(), "skipped")
        .when(target == F.col("leader_port"), "direct")
        .otherwise("rewire")
    )
    return rows.select(
        "cluster", "name", "port", target.alias("current_port"), action.alias("action"),
        "leader_name", "leader_port",
    )


def promotion_plan(nodes: DataFrame, leaders: DataFrame) -> DataFrame:
    """Each follower's priority, set only while both versions are present, and the candidates."""
    rows = topo.data_plane(nodes)
    rows = lookup_join(rows, _facts(rows, leaders), "cluster")
    mixed = (F.col("v6") > 0) & (F.col("v8") > 0)
    return topo.skip_leader(rows.where(F.col("leader_port") > 0)).select(
        "cluster", "name", "port", "version",
        F.when(mixed, priority_for(F.col("version"))).alias("priority"),
        (F.col("version") != 6).alias("candidate"),
    )


def priority_convergence(nodes: DataFrame, leaders: DataFrame, view: DataFrame) -> DataFrame:
    """Planned (port, priority) pairs that the first coordinator does not show yet."""
    planned = promotion_plan(nodes, leaders).where(F.col("priority").isNotNull())
    planned = planned.select("cluster", "port", F.col("priority").cast("bigint").alias("priority"))
    return topo.unmet(planned, topo.listed_now(view), ["cluster", "port", "priority"])


def isolation_plan(nodes: DataFrame, leaders: DataFrame) -> DataFrame:
    """The v6 nodes to detach: all but the leader."""
    rows = topo.data_plane(nodes).where(F.col("version") == 6)
    rows = lookup_join(rows, leaders.select("cluster", "leader_port"), "cluster", "left")
    return topo.skip_leader(rows).select("cluster", "name", "port")


def removal_check(nodes: DataFrame, view: DataFrame) -> DataFrame:
    """Whether each node may be removed, and why not."""
    led = topo.leader_answers(topo.last_replies(view, "master")).where("told").select("cluster", "port").distinct().withColumn("leads", F.lit(True))
    rows = nodes.join(led, ["cluster", "port"], "left")
    reason = (
        F.when(F.col("role_label") == topo.COORDINATOR_ROLE, "coordinator")
        .when(F.coalesce("cluster", F.lit("")) == "", "no cluster")
        .when(F.col("leads"), "current leader")
    )
    return rows.select("name", "cluster", "port", reason.isNull().alias("may_go"), reason.alias("reason"))


def removal_preview(nodes: DataFrame) -> DataFrame:
    """Everything under management that a teardown would remove."""
    versioned = F.when(F.col("version") > 0, F.format_string("v%d  port=%d", "version", "port"))
    in_cluster = F.when(F.col("cluster") != "", F.concat(F.lit("cluster="), F.col("cluster")))
    return nodes.select("name", "role_label", F.concat_ws("  ", versioned, in_cluster).alias("detail"))


def exporter_layout(nodes: DataFrame, shared_name: str = "fleet-redis-exporter", keys: list[str] | None = None) -> DataFrame:
    """How metrics of nodes are exported: not at all, by one shared exporter, or by older ones per node."""
    is_exporter = F.col("role_label") == topo.EXPORTER_ROLE
    counts = nodes.groupBy(*(keys or [])).agg(
        F.count_if(is_exporter).alias("exporters"),
        F.count_if(is_exporter & (F.col("name") == shared_name)).alias("shared"),
    )
    layout = (
        F.when(F.col("exporters") == 0, "none")
        .when((F.col("exporters") == 1) & (F.col("shared") == 1), "shared")
        .otherwise("per node")
    )
    return counts.select(*(keys or []), "exporters", layout.alias("layout"))


# -- lifecycle -----------------------------------------------------------------------------------


def lifecycle_progress(states: DataFrame) -> DataFrame:
    """Every state of every cluster with its mark, the trigger that leaves it, and its command.

    A stored state that the lifecycle does not reach gives a single row marked ``unknown``.
    """
    spark = states.sparkSession
    order = state_order(spark).agg(F.array_sort(F.collect_list(F.struct("depth", "state"))).alias("order"))
    rows = states.select("cluster", F.col("state").alias("current_state"), order.scalar()["state"].alias("path"))
    at = F.array_position("path", F.col("current_state")) - 1
    known = rows.withColumn("at", at).select(
        "cluster", "current_state", "at",
        F.posexplode(F.when(F.col("at") >= 0, F.col("path")).otherwise(F.array("current_state"))).alias("position", "state"),
    )
    trigger = F.try_element_at(literal_map((s, t) for s, t, _ in EDGES), F.col("state"))
    return known.select(
        "cluster", "position", "state",
        F.when(F.col("at") < 0, "unknown").otherwise(step_mark(F.col("position"), F.col("at"))).alias("mark"),
        trigger.alias("trigger"),
        command_for(trigger, F.col("cluster")).alias("command"),
        ((F.col("position") == F.col("at")) & trigger.isNotNull()).alias("next"),
    )


def next_step(states: DataFrame) -> DataFrame:
    """The first allowed trigger of each cluster with its command; no row at the end."""
    trigger = F.get(allowed(F.col("state")), F.lit(0))
    return states.select(
        "cluster", "state", trigger.alias("trigger"), command_for(trigger, F.col("cluster")).alias("command")
    ).where(F.col("trigger").isNotNull())


def not_ready(states: DataFrame) -> DataFrame:
    """Clusters that new v8 coordinators must not take over yet."""
    return states.where(~F.col("state").isin(READY_FOR_V8)).select("cluster", "state")


def first_states(nodes: DataFrame) -> DataFrame:
    """The state each cluster starts in, from the version of its first data-plane node."""
    first = topo.data_plane(nodes).groupBy("cluster").agg(F.min_by("version", "port").alias("version"))
    return first.select("cluster", initial_state(F.col("version")).alias("state"))


def derived_triggers(nodes: DataFrame, leaders: DataFrame, coordinators: DataFrame, states: DataFrame) -> DataFrame:
    """The trigger that each cluster's facts imply in its stored state, if any.

    A v8 node in `AllV6`; a v8 leader in `MixedVersions`; no v6 node left in `ReplicationBroken`;
    v8 coordinators present for every cluster in `V6Destroyed`, registered or not; no v6
    coordinator left for every cluster in `V8SentinelsAdded`.
    """
    plane = topo.data_plane(nodes)
    by_port = plane.select(
        "cluster", F.col("port").alias("leader_port"), (F.col("version") != 6).alias("leader_v8")
    )
    led = leaders.select("cluster", "leader_port").join(by_port, ["cluster", "leader_port"])
    led = led.groupBy("cluster").agg(F.bool_or("leader_v8").alias("leader_v8"))
    facts = states.join(topo.version_mix(plane), "cluster", "left").join(led, "cluster", "left")
    any_v8 = topo.has_version(coordinators, 8).scalar()
    any_v6 = topo.has_version(coordinators, 6).scalar()
    state = F.col("state")
    trigger = (
        F.when((state == "AllV6") & (F.col("v8") > 0), "AddV8Instance")
        .when((state == "MixedVersions") & F.col("leader_v8"), "Failover")
        .when((state == "ReplicationBroken") & (F.coalesce("v6", F.lit(0)) == 0), "DestroyV6")
        .when((state == "V6Destroyed") & any_v8, "AddV8Sentinels")
        .when((state == "V8SentinelsAdded") & ~any_v6, "RemoveV6Sentinels")
    )
    return facts.select("cluster", "state", trigger.alias("trigger")).where(F.col("trigger").isNotNull())


# -- coordinators --------------------------------------------------------------------------------


def _ports(coordinators: DataFrame, version_is_new) -> object:
    """The coordinators' ports as one sorted array. Their number is bounded by the port range
    they are started from."""
    return coordinators.where(version_is_new).agg(F.array_sort(F.collect_list("port"))).scalar()


def registration_plan(states: DataFrame, view: DataFrame, coordinators: DataFrame, new_version: int = 8) -> DataFrame:
    """For each cluster in `V6Destroyed`: where new coordinators find it, and the quorum for all.

    The coordinators to register with, and those that only get the new quorum, stay arrays: one
    row per cluster, not one per cluster and coordinator. A cluster whose leader no prior
    coordinator tells is skipped; there is no plan at all without new or prior coordinators.
    """
    is_new = F.col("version") == new_version
    prior = coordinators.where(~is_new).select("ord", "coordinator")
    # Who is there is known already, so nothing is too old.
    known = topo.current_leader(view.join(prior, ["ord", "coordinator"], "left_semi"), look_back=None)
    new_ports, prior_ports = _ports(coordinators, is_new), _ports(coordinators, ~is_new)
    ready = states.where(F.col("state") == "V6Destroyed").select("cluster")
    plan = ready.join(known, "cluster", "left").select(
        "cluster", "leader_host", "leader_port",
        F.col("leader_port").isNull().alias("skipped"),
        topo.majority(coordinators.agg(F.count("*")).scalar()).alias("quorum"),
        new_ports.alias("new_ports"), prior_ports.alias("prior_ports"),
    )
    return plan.where((F.size("new_ports") > 0) & (F.size("prior_ports") > 0))


def quorum_plan(view: DataFrame, coordinators: DataFrame) -> DataFrame:
    """The quorum to push for each cluster the first remaining coordinator knows, and to whom."""
    first = coordinators.agg(F.min_by("ord", "port")).scalar()
    known = topo.masters(view).where(F.col("ord") == first).select(F.col("name").alias("cluster"))
    return known.select(
        "cluster",
        topo.majority(coordinators.agg(F.count("*")).scalar()).alias("quorum"),
        _ports(coordinators, F.lit(True)).alias("ports"),
    )
