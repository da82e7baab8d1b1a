"""Inventory, scopes, coordinators' answers and per-cluster facts."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.functions import addr, atoi, atoi_or_zero, kv_get, replication_state
from fleetpulse.functions.numbers import seconds
from fleetpulse.operators.probes import latest
from fleetpulse.operators.sizing import few, written

# The roles of the data plane, and those of probes, current one first.
DATA_ROLES = ["master", "replica"]
PROBE_ROLES = ["client-workload", "client-enqueuer", "client-dequeuer"]
COORDINATOR_ROLE = "sentinel"
EXPORTER_ROLE = "redis-exporter"

#: A coordinator that was asked nothing for so long is gone.
LOOK_BACK = "5m"


# -- inventory -----------------------------------------------------------------------------------


def label_filter(containers: DataFrame, wanted: dict[str, str], prefix: str = "fleet") -> DataFrame:
    """Containers under management whose labels hold all the wanted pairs."""
    cond = F.try_element_at("labels", F.lit(f"{prefix}.managed")) == "true"
    for key, value in wanted.items():
        cond = cond & (F.try_element_at("labels", F.lit(key)) == value)
    return containers.where(cond)


def nodes(containers: DataFrame, wanted: dict[str, str] | None = None, prefix: str = "fleet") -> DataFrame:
    """The inventory with typed columns. A version or port that does not parse, or fit, is 0."""

    def label(name: str) -> Column:
        return F.coalesce(F.try_element_at("labels", F.lit(f"{prefix}.{name}")), F.lit(""))

    return label_filter(containers, wanted or {}, prefix).select(
        "id",
        F.regexp_replace(F.get("names", F.lit(0)), "^/", "").alias("name"),
        label("role").alias("role_label"),
        F.coalesce(atoi_or_zero(label("version")).try_cast("int"), F.lit(0)).alias("version"),
        atoi_or_zero(label("port")).alias("port"),
        label("cluster").alias("cluster"),
        "status",
    )


def data_plane(df: DataFrame) -> DataFrame:
    return df.where(F.col("role_label").isin(DATA_ROLES))


def skip_leader(df: DataFrame) -> DataFrame:
    """All nodes but the one on `leader_port`; all of them where no leader is known."""
    return df.where(F.col("port") != F.coalesce("leader_port", F.lit(0)))


def by_role(df: DataFrame, *roles: str) -> DataFrame:
    return df.where(F.col("role_label").isin(*roles))


def by_cluster(df: DataFrame, cluster: str | None) -> DataFrame:
    """One cluster's rows, or all rows if no cluster is given."""
    return df if cluster is None else df.where(F.col("cluster") == cluster)


def node(df: DataFrame, name: str) -> DataFrame:
    """The first node of that name in port order; no row if there is none."""
    return df.where(F.col("name") == name).orderBy("port").limit(1)


def node_labelled(containers: DataFrame, name: str, prefix: str = "fleet") -> DataFrame:
    """The first node by port whose label names it so, whatever its container is called."""
    return nodes(containers, {f"{prefix}.name": name}, prefix).orderBy("port").limit(1)


def probes(df: DataFrame) -> DataFrame:
    """Probe containers of every role, with their place in role order."""
    place = F.array_position(F.array(*[F.lit(r) for r in PROBE_ROLES]), F.col("role_label"))
    return by_role(df, *PROBE_ROLES).withColumn("role_order", place)


def container_table(df: DataFrame) -> DataFrame:
    """The listing of containers: ``-`` for no cluster, blank for version or port 0."""

    def unless_zero(c: str) -> Column:
        return F.when(F.col(c) > 0, F.col(c).cast("string")).otherwise("")

    return df.select(
        "name", "role_label", unless_zero("version").alias("version"), unless_zero("port").alias("port"),
        F.when(F.col("cluster") == "", "-").otherwise(F.coalesce("cluster", F.lit("-"))).alias("cluster"),
        "status",
    )


def clusters(df: DataFrame) -> DataFrame:
    """Distinct cluster names that are not empty."""
    return df.where(F.col("cluster") != "").select("cluster").distinct()


def with_report(df: DataFrame) -> DataFrame:
    """Add the struct `report` read from `info_text`; null where a node is unreachable."""
    return df.withColumn("report", replication_state(F.col("info_text")))


def cluster_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("cluster").agg(F.count("*").alias("nodes"))


def has_version(df: DataFrame, version: int, keys: list[str] | None = None) -> DataFrame:
    """Whether any row has that version; false for no rows at all."""
    found = F.coalesce(F.bool_or(F.col("version") == version), F.lit(False))
    return df.groupBy(*(keys or [])).agg(found.alias("found"))


def version_mix(df: DataFrame) -> DataFrame:
    """Per cluster: nodes of v6 and of every other version, which counts as v8."""
    return df.groupBy("cluster").agg(
        F.count_if(F.col("version") == 6).alias("v6"), F.count_if(F.col("version") != 6).alias("v8")
    )


def quorum(coordinators: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The majority of a coordinator fleet, and whether its size is even (no clear majority)."""
    return coordinators.groupBy(*(keys or [])).agg(F.count("*").alias("coordinators")).select(
        *(keys or []),
        "coordinators",
        majority(F.col("coordinators")).alias("quorum"),
        (F.col("coordinators") % 2 == 0).alias("even"),
    )


def majority(n: Column) -> Column:
    return F.floor(n / 2) + 1


def free_slots(used: DataFrame, groups: list[str], lo: int, hi: int, n: int) -> DataFrame:
    """`n` ports of the inclusive range for each group, in the groups' order; none twice.

    A port that any row uses, of whatever group, is taken. When no port is left, the groups that
    come later get fewer or none. Only as many groups are numbered as the range could serve.
    """
    if lo >= hi:
        raise ValueError("the range's start must be less than its end")
    spark = used.sparkSession
    taken = used.where(F.col("port").between(lo, hi)).select("port")
    free = spark.range(lo, hi + 1).toDF("port").join(taken, "port", "left_anti")
    rank = F.row_number().over(Window.orderBy("port")) - 1
    free = free.withColumn("_rank", rank).select(
        "port", F.floor(F.col("_rank") / n).alias("_turn"), (F.col("_rank") % n + 1).alias("slot"))
    served = used.select(*groups).distinct().orderBy(*groups).limit((hi - lo) // n + 1)
    turns = served.withColumn("_turn", (F.row_number().over(Window.orderBy(*groups)) - 1).cast("bigint"))
    return turns.join(free, "_turn").select(*groups, "port", "slot")


# -- coordinators --------------------------------------------------------------------------------


def coordinator_rows(view: DataFrame) -> DataFrame:
    """Coordinators' replies with typed columns. `port` is null if it does not parse."""

    def text(key: str) -> Column:
        return F.coalesce(kv_get(F.col("kv"), key), F.lit(""))

    return view.select(
        "poll_ts", "ord", "coordinator", "version", "cluster", "kind", "ok",
        text("name").alias("name"), text("ip").alias("ip"), atoi(text("port")).alias("port"),
        atoi_or_zero(text("slave-priority")).alias("priority"),
    )


def leader_answers(view: DataFrame) -> DataFrame:
    """Replies on a cluster's leader; `told` is false if there was no answer or no valid port."""
    rows = coordinator_rows(view.where(F.col("kind") == "master"))
    return rows.withColumn("told", F.col("ok") & F.col("port").isNotNull())


def followers(view: DataFrame) -> DataFrame:
    """Listed followers. `addr` is null for an entry without address or port."""
    rows = coordinator_rows(view.where(F.col("kind") == "replicas"))
    valid = (F.col("ip") != "") & (F.col("port") != 0)
    return rows.select(
        "poll_ts", "ord", "coordinator", "cluster", "ok", "ip", "port", "priority",
        F.when(valid, addr(F.col("ip"), F.col("port"))).alias("addr"),
    )


def validity(view: DataFrame) -> DataFrame:
    """From when to when each coordinator was asked at each place; only narrow columns are read."""
    return view.groupBy("ord", "coordinator", "version").agg(
        F.min("poll_ts").alias("from_ts"), F.max("poll_ts").alias("to_ts")
    )


def coordinators(view: DataFrame, at: datetime | None = None, look_back: str | None = LOOK_BACK) -> DataFrame:
    """The coordinators there are at `at` (by default the newest poll), with the port at the end of their name.

    One that was not asked within `look_back` is gone. One that has moved is at its last place alone,
    and a place has its last coordinator alone. A listing without `poll_ts` is of now."""
    if "poll_ts" not in view.columns:
        return view.select("ord", "coordinator", "version").distinct().withColumn("port", _port_of("coordinator"))
    seen = validity(view if at is None else view.where(F.col("poll_ts") <= F.lit(at)))
    now = seen.agg(F.max("to_ts")).scalar() if at is None else F.lit(at)
    if look_back is not None:
        seen = seen.where(F.col("to_ts") > now - F.make_dt_interval(secs=F.lit(seconds(look_back)).cast("decimal(18,6)")))
    # A few rows: one for each coordinator and place that ever was.
    of_name = Window.partitionBy("coordinator").orderBy(F.desc("to_ts"), F.desc("from_ts"), "ord")
    seen = seen.withColumn("_place", F.row_number().over(of_name)).where("_place = 1")
    of_place = Window.partitionBy("ord").orderBy(F.desc("to_ts"), F.desc("from_ts"), "coordinator")
    here = seen.withColumn("_turn", F.row_number().over(of_place)).where("_turn = 1")
    return here.select("ord", "coordinator", "version", _port_of("coordinator").alias("port"))


def _port_of(name: str) -> Column:
    return F.substring_index(name, "-", -1).try_cast("bigint")


def last_replies(view: DataFrame, kind: str, at: datetime | None = None, look_back: str | None = LOOK_BACK) -> DataFrame:
    """The replies of each cluster's last poll of a kind at every coordinator there is.

    Which polls these are is found in narrow columns first, and written: replies older than the oldest
    of them are skipped where they are stored, and only those that meet the last polls are taken apart.
    """
    asked = view.where(F.col("kind") == kind) if at is None else view.where((F.col("kind") == kind) & (F.col("poll_ts") <= F.lit(at)))
    place = ["cluster", "ord", "coordinator"]
    last = asked.groupBy(*place).agg(F.max("poll_ts").alias("poll_ts"))
    last = written(last.join(coordinators(view, at, look_back), ["ord", "coordinator"], "left_semi").select(*place, "poll_ts"), "last-polls")
    oldest = last.agg(F.min("poll_ts")).first()[0]
    recent = asked.where(F.col("poll_ts") >= F.lit(oldest).cast("timestamp_ntz"))
    return recent.join(F.broadcast(last) if few(last) else last, [*place, "poll_ts"], "left_semi")


def current_leader(view: DataFrame, at: datetime | None = None, look_back: str | None = LOOK_BACK) -> DataFrame:
    """Each cluster's leader as told by the first coordinator there is, in order, whose last reply tells it."""
    told = leader_answers(last_replies(view, "master", at, look_back)).where("told")
    return told.groupBy("cluster").agg(F.min_by(F.struct("ip", "port", "ord"), "ord").alias("first")).select(
        "cluster", F.col("first.ip").alias("leader_host"), F.col("first.port").alias("leader_port"),
        F.col("first.ord").alias("told_by"),
    )


def masters(view: DataFrame, at: datetime | None = None, look_back: str | None = LOOK_BACK) -> DataFrame:
    """Leaders by coordinator, from its last reply on each cluster if that is good; unnamed ones are dropped."""
    rows = leader_answers(last_replies(view, "master", at, look_back)).where("ok and name <> ''")
    last = latest(rows, ["ord", "coordinator", "name"], ["ip", "port"], ["poll_ts"])
    host_port = addr(F.col("ip"), F.coalesce(F.col("port"), F.lit(0)))
    return last.select("ord", "coordinator", "name", host_port.alias("address"))


def discovered_masters(view: DataFrame, at: datetime | None = None, look_back: str | None = LOOK_BACK) -> DataFrame:
    """The leaders that the first coordinator with a good last reply lists, even if it lists few."""
    replies = written(last_replies(view, "master", at, look_back), "last-replies")
    first = replies.where("ok").agg(F.min("ord"))
    return masters(replies, at, None).where(F.col("ord") == first.scalar()).select("name", "address")


def pick_leader(listed: DataFrame, name: str | None = None) -> DataFrame:
    """Mark the leader to probe: the named one, or the only one.

    All listed leaders stay as rows, as the choices to offer; `problem` says why none is chosen. If
    nothing is listed, one row without a leader says so.
    """
    wanted = F.lit(True) if name is None else F.col("name") == name
    hits = listed.agg(F.count_if(wanted)).scalar()
    if name is None:
        problem = F.when(hits != 1, "several leaders, choose one by name")
        chosen = hits == 1
    else:
        problem = F.when(hits == 0, F.concat(F.lit("no such leader: "), F.lit(name)))
        chosen = wanted
    spark = listed.sparkSession
    nothing = spark.createDataFrame([(None, None, False, "no leaders are listed")], "name string, address string, chosen boolean, problem string")
    nothing = nothing.where(listed.agg(F.count("*")).scalar() == 0)
    return listed.select("name", "address", chosen.alias("chosen"), problem.alias("problem")).unionByName(nothing)


def listed_now(view: DataFrame, at: datetime | None = None, look_back: str | None = LOOK_BACK) -> DataFrame:
    """The followers that each cluster's first coordinator with a good last refresh lists."""
    rows = followers(last_replies(view, "replicas", at, look_back)).where("ok")
    return rows.withColumn("_first", F.min("ord").over(Window.partitionBy("cluster"))).where("ord = _first").drop("_first")


def visible(expected: DataFrame, view: DataFrame) -> DataFrame:
    """Expected (cluster, port) rows that the first coordinator with a good last refresh lists as followers."""
    return expected.join(listed_now(view).select("cluster", "port"), ["cluster", "port"], "left_semi")


def unmet(expected: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Expected rows not yet seen; none left means satisfied. Seen rows beyond them do not matter."""
    return expected.join(seen.select(*keys), keys, "left_anti")
