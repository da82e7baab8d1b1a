"""The logical tables as row-wise mappings of the given Parquet tables.

Each function takes the session and the folder of the tables, and reads only the columns it
needs. All mappings are deterministic. The session time zone is set to UTC, as the tables'
timestamps carry no zone.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"
POLL_SECONDS = 10

# Fixed values of the mappings.
ERROR_TEXTS = [
    "READONLY You can't write against a read only replica.",
    "LOADING Dataset is loading in memory",
    "MASTERDOWN Link with MASTER is down",
    "dial tcp: i/o timeout",
    "context deadline exceeded",
    "dial tcp: connection refused",
    "EOF",
    "write: broken pipe",
    "read: connection reset by peer",
    "redis: nil",
    "ERR unknown command",
]
ODD_VALUES = ["garbage", "1:2:3", " 5:6", "99999999999999999999:1"]
TRIGGERS = [
    "AddV8Instance", "Failover", "BreakReplication", "DestroyV6", "AddV8Sentinels", "RemoveV6Sentinels",
]
EXPORTER_METRICS = [
    "redis_up", "redis_connected_clients", "redis_memory_used_bytes", "redis_db_keys",
    "redis_commands_processed_total", "redis_master_link_up", "redis_master_repl_offset",
    "redis_slave_repl_offset",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _one_of(texts: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(t) for t in texts]), index.cast("int"))


def nanos(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 1000


def poll_time(number: Column) -> Column:
    """The time of the poll with that number."""
    return F.expr(EPOCH) + F.make_dt_interval(secs=(number * POLL_SECONDS).cast("decimal(18,6)"))


def probe_log_of(events: DataFrame) -> DataFrame:
    """`probe_log` rows of `events` rows; works on a batch and on a stream."""
    e = F.col("event_id")
    role = (
        F.when(F.col("event_type").isin("signup", "purchase"), "write")
        .when(F.col("event_type") == "click", "master_read")
        .when(F.col("event_type") == "view", "replica_read")
        .otherwise(_one_of(["write", "master_read", "replica_read"], e % 3))
    )
    failed = F.col("event_type") == "error"
    ns = nanos(F.col("ts"))
    n = F.when(role == "write", e).when(role == "master_read", e - 1).otherwise(
        e - 1 - F.col("user_id") % 7
    )
    written = F.when(role == "write", ns).when(role == "master_read", ns - (e % 50) * 1000000).otherwise(
        ns - (e % 400) * 5000000
    )
    return events.select(
        e.alias("seq"),
        "ts",
        F.concat(F.lit("c"), F.col("user_id") % 5).alias("cluster"),
        role.alias("role"),
        F.concat(F.lit("r"), F.col("user_id") % 15).alias("replica"),
        (F.col("value") / 200.0).alias("dur_s"),
        F.when(failed, _one_of(ERROR_TEXTS, e % 11)).alias("err"),
        (failed & (e % 13 == 0)).alias("net_timeout"),
        F.when(
            ~failed,
            F.when(e % 97 == 0, _one_of(ODD_VALUES, e % 4)).otherwise(F.concat_ws(":", n, written)),
        ).alias("raw"),
    )


def probe_log(spark: SparkSession, folder: str) -> DataFrame:
    return probe_log_of(table(spark, folder, "events"))


def slow_probe_log(spark: SparkSession, folder: str) -> DataFrame:
    """Leader reads whose value moves only every 200 events, and at times falls back."""
    e = F.col("seq")
    n = e - e % 200 - F.when(F.floor(e / 700) % 3 == 2, 500).otherwise(0)
    reads = probe_log(spark, folder).where((F.col("role") == "master_read") & F.col("err").isNull())
    return reads.withColumn("raw", F.concat_ws(":", n, nanos(F.col("ts")) - (e % 200) * 13000000000))


def node_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Inventory rows with the text of each node's own report (null: unreachable)."""
    k = F.col("c_custkey")
    role_label = (
        F.when(k < 25, "master")
        .when(F.col("c_mktsegment") == "FURNITURE", "sentinel")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "client-workload")
        .otherwise("replica")
    )
    rep_role = (
        F.when(k < 25, "master")
        .when(k % 11 == 0, F.lit(None).cast("string"))
        .when(k % 11 == 1, "master")
        .when(k % 11 == 2, "sync")
        .otherwise("slave")
    )
    target = F.when(k % 4 == 0, 6380 + k - 25).otherwise(6380 + k % 25)
    follows = F.concat(
        F.lit("\r\nmaster_host:10.0.0."), k % 25, F.lit("\r\nmaster_port:"), target,
        F.lit("\r\nmaster_link_status:"), F.when(k % 7 == 0, "down").otherwise("up"),
    )
    return table(spark, folder, "customer").select(
        F.concat(F.lit("node-"), k).alias("name"),
        F.concat(F.lit("c"), k % 25).alias("cluster"),
        role_label.alias("role_label"),
        F.when(k % 7 == 0, "Exited (0)").otherwise("Up 5 minutes").alias("status"),
        F.when(k % 3 == 0, 8).otherwise(6).alias("version"),
        (6380 + k).alias("port"),
        F.concat(
            F.lit("# Replication\r\nrole:"), rep_role,
            F.when(rep_role == "slave", follows).otherwise(""),
            F.lit("\r\nconnected_slaves:0\r\n"),
        ).alias("info_text"),
    )


def leaders_told(spark: SparkSession, folder: str) -> DataFrame:
    """What coordinators say of each cluster now: port 6380 + cluster number; 0, no answer, for c24."""
    c = F.col("c_custkey") % 25
    return table(spark, folder, "customer").select(
        F.concat(F.lit("c"), c).alias("cluster"), F.when(c == 24, 0).otherwise(6380 + c).alias("leader_port")
    ).distinct()


def node_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Containers with their label maps, of every role; some labels are missing or do not parse."""
    k = F.col("c_custkey")
    role = (
        F.when(k % 20 == 17, "redis-exporter").when(k % 20 == 18, "prometheus")
        .when(k % 20 == 19, "client-enqueuer").when(k % 20 == 16, "client-workload")
        .when(k % 20 == 15, "sentinel").when(k < 25, "master").otherwise("replica")
    )
    plain = role.isin("redis-exporter", "prometheus", "sentinel")
    text = {
        "fleet.managed": F.when(k % 31 == 30, "false").otherwise("true"),
        "fleet.role": role,
        "fleet.cluster": F.when(~plain, F.concat(F.lit("c"), k % 25)),
        "fleet.version": F.when(k % 29 == 0, "six").when(k % 3 == 0, "8").otherwise("6"),
        "fleet.port": F.when(k % 37 != 0, (6380 + k).cast("string")),
        "fleet.name": F.concat(F.lit("node-"), k),
    }
    entries = F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in text.items()])
    return table(spark, folder, "customer").select(
        F.format_string("%012x", k).alias("id"),
        F.array(F.concat(F.lit("/node-"), k)).alias("names"),
        F.map_from_entries(F.filter(entries, lambda x: x["value"].isNotNull())).alias("labels"),
        F.when(k % 7 == 0, "Exited (0)").otherwise("Up 5 minutes").alias("status"),
    )


def discovered_target(spark: SparkSession, folder: str) -> DataFrame:
    """One row per container and attached network, as discovery labels."""
    rows = node_labels(spark, folder).withColumn(
        "network", F.explode(F.array(F.lit("fleet"), F.lit("bridge")))
    )
    found = F.transform_keys(
        "labels",
        lambda key, _: F.concat(F.lit("__meta_docker_container_label_"), F.replace(key, F.lit("."), F.lit("_"))),
    )
    ip = F.concat(
        F.when(F.col("network") == "fleet", "172.18.").otherwise("172.17."),
        F.substring("id", 9, 4),
    )
    return rows.select(
        F.map_concat(
            found,
            F.create_map(
                F.lit("__meta_docker_network_name"), "network", F.lit("__meta_docker_network_ip"), ip,
                F.lit("__meta_docker_container_label_fleet_target_port"), F.lit("9300"),
            ),
        ).alias("labels")
    )


def _coordinator(poll: Column) -> Column:
    """Who is asked at the place poll % 3: 26379 to 26381, but in the first 900 polls one that was removed
    later has the place 1, and in the first 300 the one of place 1 has the place 0."""
    port = F.when((poll % 3 == 1) & (poll < 900), 26370).when((poll % 3 == 0) & (poll < 300), 26380).otherwise(26379 + poll % 3)
    return F.concat(F.lit("fleet-sentinel-"), port)


def coordinator_view(spark: SparkSession, folder: str) -> DataFrame:
    return leader_polls(spark, folder).unionByName(follower_polls(spark, folder))


def leader_polls(spark: SparkSession, folder: str) -> DataFrame:
    return leader_polls_of(table(spark, folder, "orders"))


def leader_polls_of(orders: DataFrame) -> DataFrame:
    """One reply per poll on a cluster's leader, from `orders`. The leader moves every 40 polls."""
    o, c = F.col("o_orderkey"), F.col("o_custkey") % 25
    port = 6380 + c + 25 * (F.floor(o / 40) % 3)
    said = F.when(o % 29 == 0, "n/a").otherwise(port.cast("string"))
    ok = F.col("o_orderstatus") != "P"
    cluster = F.concat(F.lit("c"), c)
    return orders.select(
        poll_time(o).alias("poll_ts"),
        (o % 3).cast("int").alias("ord"),
        _coordinator(o).alias("coordinator"),
        F.when(o % 3 == 2, 8).otherwise(6).alias("version"),
        cluster.alias("cluster"),
        F.lit("master").alias("kind"),
        ok.alias("ok"),
        F.when(
            ok,
            F.when(
                o % 5 == 0,
                F.array(F.lit("port"), F.lit("1"), F.lit("name"), cluster, F.lit("ip"),
                        F.concat(F.lit("10.0.0."), c), F.lit("port"), said, F.lit("flags")),
            ).otherwise(
                F.array(F.lit("name"), F.when(o % 41 == 0, "").otherwise(cluster), F.lit(""), F.lit("x"),
                        F.lit("ip"), F.concat(F.lit("10.0.0."), c), F.lit("port"), said)
            ),
        ).alias("kv"),
    )


def report_polls(spark: SparkSession, folder: str) -> DataFrame:
    """Polls of nodes' own reports over time, from `orders`, with the leader they should follow."""
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat(
        F.lit("role:slave\r\nmaster_host:10.0.0.1\r\nmaster_port:"), 6380 + k % 25 + F.when(o % 3 == 0, 25).otherwise(0),
        F.lit("\r\nmaster_link_status:"), F.when(o % 5 == 0, "down").otherwise("up"), F.lit("\r\n"),
    )
    return table(spark, folder, "orders").select(
        F.concat(F.lit("c"), k % 25).alias("cluster"), (6380 + k).alias("port"), poll_time(o).alias("poll_ts"),
        (6380 + k % 25).alias("leader_port"), F.when(F.col("o_orderstatus") != "P", text).alias("info_text"),
    )


def node_starts(spark: SparkSession, folder: str) -> DataFrame:
    """A start for each node, a minute after the other."""
    k = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        F.concat(F.lit("c"), k % 25).alias("cluster"), (6380 + k).alias("port"), k.alias("id"),
        (F.expr(EPOCH) + F.make_dt_interval(mins=k.cast("int"))).alias("ts"),
    )


def follower_polls_of(lineitem: DataFrame) -> DataFrame:
    """One row per listed follower and refresh, from `lineitem`; the refresh is the order."""
    o, s = F.col("l_orderkey"), F.col("l_suppkey") % 8
    ok = o % 10 != 0
    none = F.array().cast("array<string>")
    return lineitem.select(
        poll_time(o).alias("poll_ts"),
        (o % 3).cast("int").alias("ord"),
        _coordinator(o).alias("coordinator"),
        F.when(o % 3 == 2, 8).otherwise(6).alias("version"),
        F.concat(F.lit("c"), o % 25).alias("cluster"),
        F.lit("replicas").alias("kind"),
        ok.alias("ok"),
        F.when(
            ok,
            F.concat(
                F.when(F.col("l_linenumber") == 2, F.array(F.lit("port"), F.lit("1"))).otherwise(none),
                F.when(F.col("l_linenumber") == 4, F.array(F.lit(""), F.lit("x"))).otherwise(none),
                F.array(
                    F.lit("ip"),
                    F.when(F.col("l_partkey") % 50 == 0, "").otherwise(F.concat(F.lit("10.0.1."), s)),
                    F.lit("port"),
                    F.when(F.col("l_partkey") % 50 == 1, "x").otherwise((6380 + o % 25 + 25 * s).cast("string")),
                    F.lit("slave-priority"),
                    F.when(F.col("l_quantity") > 25, "100").otherwise("1"),
                ),
                F.when(F.col("l_linenumber") == 3, F.array(F.lit("flags"))).otherwise(none),
            ),
        ).alias("kv"),
    )


def follower_polls(spark: SparkSession, folder: str) -> DataFrame:
    return follower_polls_of(table(spark, folder, "lineitem"))


def trigger_log_of(orders: DataFrame) -> DataFrame:
    """`trigger_log` rows of `orders` rows; works on a batch and on a stream."""
    return orders.select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderdate").alias("ts"),
        F.concat(F.lit("c"), F.col("o_custkey")).alias("cluster"),
        _one_of(TRIGGERS, F.col("o_orderkey") % 6).alias("trig"),
        (F.col("o_orderstatus") != "P").alias("ok"),
    )


def trigger_log(spark: SparkSession, folder: str) -> DataFrame:
    return trigger_log_of(table(spark, folder, "orders"))


def probe_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Sampled probe counters of two probes per cluster, one sample per event; each counter restarts now and then."""
    e, u = F.col("event_id"), F.col("user_id")
    kind = F.when(F.col("event_type") == "error", _one_of(
        ["readonly", "loading", "master_down", "timeout", "network", "other"], e % 6))
    replica = F.concat(F.lit("r"), u % 15)
    cluster = F.concat(F.lit("c"), u % 5)
    status = F.when(F.col("value") > 60, "error").otherwise("ok")
    error_metric = F.when(e % 2 == 0, "probe_write_errors_total").otherwise("probe_replica_read_errors_total")
    metric = (
        F.when(F.col("event_type").isin("signup", "purchase"), "probe_writes_total")
        .when(F.col("event_type") == "click", "probe_master_reads_total")
        .when(F.col("event_type") == "view", "probe_replica_reads_total")
        .otherwise(error_metric)
    )
    entries = F.array(
        F.struct(F.lit("workload_cluster").alias("key"), cluster.alias("value")),
        F.struct(F.lit("instance").alias("key"), F.concat(F.lit("probe-"), F.floor(u / 5) % 2).alias("value")),
        F.struct(F.lit("kind").alias("key"), kind.alias("value")),
        F.struct(F.lit("status").alias("key"), F.when(kind.isNull(), status).alias("value")),
        F.struct(F.lit("replica").alias("key"), F.when(metric.startswith("probe_replica"), replica).alias("value")),
    )
    return table(spark, folder, "events").select(
        metric.alias("metric"),
        F.map_from_entries(F.filter(entries, lambda x: x["value"].isNotNull())).alias("labels"),
        "ts",
        (e % 500).cast("double").alias("value"),
    )


def exporter_samples(spark: SparkSession, folder: str) -> DataFrame:
    return exporter_samples_of(table(spark, folder, "events"))


def exporter_samples_of(events: DataFrame) -> DataFrame:
    """Sampled node metrics, one sample per event; works on a batch and on a stream.

    Leaders' offsets are of one node per cluster; keys and commands are counted per database.
    """
    e, u = F.col("event_id"), F.col("user_id")
    metric = _one_of(EXPORTER_METRICS, (e + F.floor(e / 8)) % 8)
    node = u % F.when(metric == "redis_master_repl_offset", 5).otherwise(20)
    per_db = metric.isin("redis_db_keys", "redis_commands_processed_total")
    value = (
        F.when(metric.isin("redis_up", "redis_master_link_up"), F.when(F.col("value") < 90, 1).otherwise(0))
        .when(metric == "redis_commands_processed_total", e % 500)
        .when(metric == "redis_master_repl_offset", e * 100)
        .when(metric == "redis_slave_repl_offset", e * 100 - u)
        .otherwise(F.floor(F.col("value") * 10))
    )
    return events.select(
        metric.alias("metric"),
        F.create_map(
            F.lit("instance"), F.concat(F.lit("redis://node-"), node, F.lit(":"), 6380 + node),
            F.lit("redis_instance"), F.concat(F.lit("node-"), node),
            F.lit("redis_cluster"), F.concat(F.lit("c"), node % 5),
            F.lit("redis_version_major"), F.when(node % 3 == 0, "8").otherwise("6"),
            F.lit("db"), F.when(per_db, F.concat(F.lit("db"), F.floor(u / 20) % 2)),
        ).alias("labels"),
        "ts",
        value.cast("double").alias("value"),
    )


def command_log_of(lineitem: DataFrame) -> DataFrame:
    """`command_log` rows of `lineitem` rows; works on a batch and on a stream."""
    o = F.col("l_orderkey")
    node = o % 25 + 25 * (F.col("l_suppkey") % 3)
    return lineitem.select(
        (poll_time(o) + F.make_dt_interval(secs=F.col("l_linenumber").cast("decimal(18,6)"))).alias("ts"),
        (o * 10 + F.col("l_linenumber")).alias("seq"),
        F.concat(F.lit("node-"), node).alias("node"),
        F.concat(F.lit("c"), o % 25).alias("cluster"),
        F.concat(F.lit('[0 10.0.0.1:6000] "SET" "k'), F.col("l_partkey"), F.lit('"')).alias("line"),
    )


def command_log(spark: SparkSession, folder: str) -> DataFrame:
    return command_log_of(table(spark, folder, "lineitem"))
