"""For each registered query, SQL over the same tables that gives the same rows.

The SQL is written from the definitions, not from the Spark code: rates by laying a grid over the
samples, as-of by correlated lookups, replies directly from the columns they are assembled from.
"""

ORACLES: dict[str, str] = {}

PROBE_LOG = """
probe_log AS (
  SELECT event_id AS seq, ts, 'c' || (user_id % 5) AS cluster,
    CASE WHEN event_type IN ('signup', 'purchase') THEN 'write' WHEN event_type = 'click' THEN 'master_read'
         WHEN event_type = 'view' THEN 'replica_read'
         WHEN event_id % 3 = 0 THEN 'write' WHEN event_id % 3 = 1 THEN 'master_read' ELSE 'replica_read' END AS role,
    'r' || (user_id % 15) AS follower, value / 200.0 AS dur_s, event_id, user_id, event_type,
    event_type = 'error' AND event_id % 13 = 0 AS net_timeout
  FROM events),
log AS (
  SELECT *, CASE WHEN role = 'replica_read' THEN follower END AS replica,
    CASE WHEN event_type <> 'error' OR event_id % 11 = 9 THEN NULL WHEN net_timeout THEN 'timeout'
         WHEN event_id % 11 = 0 THEN 'readonly' WHEN event_id % 11 = 1 THEN 'loading'
         WHEN event_id % 11 = 2 THEN 'master_down' WHEN event_id % 11 IN (3, 4) THEN 'timeout'
         WHEN event_id % 11 IN (5, 6, 7, 8) THEN 'network' ELSE 'other' END AS kind,
    CASE WHEN event_type <> 'error' AND event_id % 97 <> 0 THEN
      CASE role WHEN 'write' THEN event_id WHEN 'master_read' THEN event_id - 1 ELSE event_id - 1 - user_id % 7 END END AS n,
    CASE WHEN event_type <> 'error' AND event_id % 97 <> 0 THEN epoch_us(ts) * 1000 -
      CASE role WHEN 'write' THEN 0 WHEN 'master_read' THEN (event_id % 50) * 1000000 ELSE (event_id % 400) * 5000000 END END AS ns
  FROM probe_log),
reads AS (SELECT *, epoch_us(ts) * 1000 - ns AS age_ns FROM log WHERE role <> 'write' AND n IS NOT NULL),
looked AS (
  SELECT seq, ts, cluster, replica, role, n, age_ns,
    last_value(CASE WHEN role = 'master_read' THEN n END IGNORE NULLS) OVER w AS leader_n,
    last_value(CASE WHEN role = 'master_read' THEN age_ns END IGNORE NULLS) OVER w AS leader_age_ns
  FROM reads WINDOW w AS (PARTITION BY cluster ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
lag AS (SELECT seq, ts, cluster, replica, leader_n - n AS lag FROM looked WHERE role = 'replica_read' AND leader_n > 0),
hist AS (
  SELECT cluster, role, replica, b.le, CAST(count(*) FILTER (WHERE dur_s <= b.le) AS BIGINT) AS cum,
    count(*) AS count, round(sum(dur_s), 6) AS sum
  FROM log, (SELECT 0.0005::DOUBLE * 2 ** i AS le FROM range(12) t(i) UNION ALL SELECT 'infinity'::DOUBLE) b
  GROUP BY ALL)
"""


def oracle(name: str, body: str, *ctes: str) -> None:
    ORACLES[name] = ("WITH RECURSIVE " + ",".join(ctes) if ctes else "") + body


def probe(name: str, body: str) -> None:
    oracle(name, body, PROBE_LOG)


OPS = """SELECT cluster, role, replica, CASE WHEN kind IS NULL THEN 'ok' ELSE 'error' END AS status,
  count(*) AS ops FROM log GROUP BY ALL"""
ERRORS = "SELECT cluster, role, replica, kind, count(*) AS errors FROM log WHERE kind IS NOT NULL GROUP BY ALL"
GAUGES = """SELECT cluster, role, replica, ts, seq, n, age_ns FROM reads
  QUALIFY row_number() OVER (PARTITION BY cluster, role, replica ORDER BY ts DESC, seq DESC) = 1"""
LAG_NOW = """SELECT cluster, replica, ts, seq, lag FROM lag
  QUALIFY row_number() OVER (PARTITION BY cluster, replica ORDER BY ts DESC, seq DESC) = 1"""
GAP = """SELECT seq, ts, cluster, replica, age_ns, leader_age_ns, age_ns - leader_age_ns AS gap_ns FROM looked
  WHERE role = 'replica_read' AND leader_age_ns IS NOT NULL"""
HIST = "SELECT cluster, role, replica, le, cum, count, sum FROM hist"

probe("op_counts", OPS)
probe("stream_op_counts", OPS)
probe("error_counts", ERRORS)
probe("latency_histogram", HIST)
probe("stream_histogram", HIST)
probe("parse_values", "SELECT seq, n, ns AS written_at_ns, n || ':' || ns AS text FROM log")
probe("value_gauges", GAUGES)
probe("value_age", "SELECT seq, cluster, role, replica, n, age_ns FROM reads")
probe("replica_lag", "SELECT * FROM lag")
probe("stream_lag", "SELECT * FROM lag")
probe("lag_by_follower", LAG_NOW)
probe("age_gap", GAP)
probe("age_by_follower", f"""SELECT cluster, replica, ts, seq, age_ns, leader_age_ns, gap_ns FROM ({GAP})
  QUALIFY row_number() OVER (PARTITION BY cluster, replica ORDER BY ts DESC, seq DESC) = 1""")
probe("latest_present", f"""SELECT l.* FROM ({LAG_NOW}) l LEFT JOIN
  (SELECT cluster, replica, max(ts) AS gone FROM log WHERE kind = 'other' AND role = 'replica_read' GROUP BY ALL) g
  USING (cluster, replica) WHERE gone IS NULL OR ts > gone""")

PER_SECOND = """SELECT cluster, role, t AS ts, count(*) / 21600.0::DOUBLE AS rate FROM log, LATERAL (
  SELECT unnest(generate_series(date_trunc('hour', ts), date_trunc('hour', ts) + INTERVAL 6 HOUR, INTERVAL 1 HOUR)) AS t) g
  WHERE t >= ts AND t - INTERVAL 6 HOUR < ts GROUP BY ALL"""
for _name in ("op_rate", "stream_op_rate"):
    probe(_name, PER_SECOND)

probe("probe_metrics", f"""
SELECT metric, cluster, replica, status, kind, TIMESTAMP '2024-01-01' AS ts, CAST(v AS DOUBLE) AS value, le FROM (
  SELECT 'probe_' || role || 's_total' AS metric, cluster, replica, status, NULL AS kind, ops AS v, NULL::DOUBLE AS le FROM ({OPS})
  UNION ALL SELECT 'probe_' || role || '_errors_total', cluster, replica, NULL, kind, errors, NULL FROM ({ERRORS})
  UNION ALL SELECT 'probe_' || role || '_duration_seconds_bucket', cluster, replica, NULL, NULL, cum, le FROM hist
  UNION ALL SELECT 'probe_' || role || '_duration_seconds_sum', cluster, replica, NULL, NULL, sum, NULL FROM hist WHERE isinf(le)
  UNION ALL SELECT 'probe_' || role || '_duration_seconds_count', cluster, replica, NULL, NULL, count, NULL FROM hist WHERE isinf(le)
  UNION ALL SELECT 'probe_' || replace(role, '_read', '') || '_value', cluster, replica, NULL, NULL, n, NULL FROM ({GAUGES})
  UNION ALL SELECT 'probe_' || replace(role, '_read', '') || '_value_age_seconds', cluster, replica, NULL, NULL,
    round(age_ns / 1e9, 6), NULL FROM ({GAUGES})
  UNION ALL SELECT 'probe_replica_lag_count', cluster, replica, NULL, NULL, lag, NULL FROM ({LAG_NOW}))""")

SLOW = """
steps AS (
  SELECT seq, ts, cluster, n, (seq % 200) * 13000000000 AS age_ns, lag(n) OVER w AS prev_n,
    lag((seq % 200) * 13000000000) OVER w AS prev_age
  FROM (SELECT *, seq - seq % 200 - CASE WHEN (seq // 700) % 3 = 2 THEN 500 ELSE 0 END AS n
        FROM (SELECT * EXCLUDE (n) FROM log) WHERE role = 'master_read' AND event_type <> 'error')
  WINDOW w AS (PARTITION BY cluster ORDER BY ts, seq))"""
oracle("stalls", """SELECT seq, ts, cluster, n, age_ns FROM steps
  WHERE n = prev_n AND age_ns > prev_age AND age_ns >= 600000000000""", PROBE_LOG, SLOW)
oracle("regressions", """SELECT seq, ts, cluster, prev_n, n, CASE WHEN n < prev_n THEN 'fell' ELSE 'skipped' END AS change
  FROM steps WHERE n < prev_n OR n > prev_n + 1""", PROBE_LOG, SLOW)

# -- sampled metrics: every window laid over its samples --------------------------------------------

PROBE_SAMPLES = """
samples AS (
  SELECT *, CASE WHEN kind IS NULL THEN CASE WHEN value > 60 THEN 'error' ELSE 'ok' END END AS status FROM (
    SELECT ts, (event_id % 500)::DOUBLE AS v, value, 'c' || (user_id % 5) AS cluster, 'probe-' || (user_id // 5 % 2) AS instance, 'r' || (user_id % 15) AS replica,
      CASE WHEN event_type IN ('signup', 'purchase') THEN 'writes' WHEN event_type = 'click' THEN 'master_reads'
           WHEN event_type = 'view' THEN 'replica_reads' WHEN event_id % 2 = 0 THEN 'write_errors' ELSE 'replica_errors' END AS metric,
      CASE WHEN event_type = 'error' THEN list_extract(
        ['readonly', 'loading', 'master_down', 'timeout', 'network', 'other'], 1 + event_id % 6) END AS kind
    FROM events))"""
NODE_SAMPLES = """
samples AS (
  SELECT ts, metric, event_id, 'redis://node-' || node || ':' || (6380 + node) AS instance,
    'c' || (node % 5) AS redis_cluster, CASE WHEN node % 3 = 0 THEN '8' ELSE '6' END AS redis_version_major,
    CASE WHEN metric IN ('redis_db_keys', 'redis_commands_processed_total') THEN 'db' || (user_id // 20 % 2) END AS db,
    CASE WHEN metric IN ('redis_up', 'redis_master_link_up') THEN CASE WHEN value < 90 THEN 1 ELSE 0 END
         WHEN metric = 'redis_commands_processed_total' THEN event_id % 500
         WHEN metric = 'redis_master_repl_offset' THEN event_id * 100
         WHEN metric = 'redis_slave_repl_offset' THEN event_id * 100 - user_id
         ELSE floor(value * 10) END::DOUBLE AS v
  FROM (SELECT *, CASE WHEN metric = 'redis_master_repl_offset' THEN user_id % 5 ELSE user_id % 20 END AS node
    FROM (SELECT *, list_extract(['redis_up', 'redis_connected_clients', 'redis_memory_used_bytes', 'redis_db_keys',
      'redis_commands_processed_total', 'redis_master_link_up', 'redis_master_repl_offset', 'redis_slave_repl_offset'],
      1 + (event_id + event_id // 8) % 8) AS metric FROM events)))"""


def _rates(series: str, where: str) -> str:
    """Windows (t - 6 h, t] with their samples: first, last, and the increase between neighbours; `rate` goes on to
    the window's edges, `between` does not. `series` are all labels that the samples have."""
    return f"""
laid AS (
  SELECT {series}, t, ts, v, lag(v) OVER (PARTITION BY {series}, t ORDER BY ts) AS prev
  FROM samples, LATERAL (SELECT unnest(generate_series(date_trunc('hour', ts),
    date_trunc('hour', ts) + INTERVAL 6 HOUR, INTERVAL 1 HOUR)) AS t) g
  WHERE t >= ts AND t - INTERVAL 6 HOUR < ts AND {where}),
windows AS (
  SELECT {series}, t, sum(CASE WHEN prev IS NULL THEN 0 WHEN v >= prev THEN v - prev ELSE v END) AS up,
    arg_min(v, ts) AS v0, (epoch_us(max(ts)) - epoch_us(min(ts)))::DOUBLE AS covered,
    (epoch_us(max(ts)) - epoch_us(min(ts)))::DOUBLE / (count(*) - 1) AS mean,
    (epoch_us(min(ts)) - epoch_us(t) + 21600000000)::DOUBLE AS before, (epoch_us(t) - epoch_us(max(ts)))::DOUBLE AS behind
  FROM laid GROUP BY {series}, t HAVING count(*) > 1),
edges AS (
  SELECT *, CASE WHEN behind >= 1.1::DOUBLE * mean THEN mean / 2 ELSE behind END AS right_gap,
    least(CASE WHEN before >= 1.1::DOUBLE * mean THEN mean / 2 ELSE before END,
      CASE WHEN up > 0 AND v0 >= 0 THEN covered * v0 / up END) AS left_gap FROM windows),
rates AS (
  SELECT {series}, t AS ts, up / 21600.0::DOUBLE AS between,
    up * ((covered + left_gap + right_gap) / covered) / 21600.0::DOUBLE AS rate FROM edges)"""


def _summed(by: str, value: str = "rate") -> str:
    return f"SELECT {by}, ts, round(sum({value}), 8) AS rate FROM rates GROUP BY ALL"


oracle("writes_per_second", _summed("cluster, status"), PROBE_SAMPLES,
       _rates("instance, cluster, status", "metric = 'writes' AND status = 'ok'"))
oracle("writes_per_second_between_samples", _summed("cluster, status", "between"), PROBE_SAMPLES,
       _rates("instance, cluster, status", "metric = 'writes' AND status = 'ok'"))
oracle("leader_reads_per_second", _summed("cluster, status"), PROBE_SAMPLES,
       _rates("instance, cluster, status", "metric = 'master_reads' AND status = 'ok'"))
oracle("follower_reads_per_second", _summed("replica"), PROBE_SAMPLES,
       _rates("instance, cluster, replica, status", "metric = 'replica_reads' AND status = 'ok'"))
oracle("failover_write_errors", _summed("kind"), PROBE_SAMPLES,
       _rates("instance, cluster, kind", "metric = 'write_errors' AND kind IN ('readonly', 'master_down', 'loading')"))
oracle("follower_read_errors", _summed("kind, replica"), PROBE_SAMPLES,
       _rates("instance, cluster, replica, kind", "metric = 'replica_errors'"))
oracle("commands_per_second", _summed("instance"), NODE_SAMPLES,
       _rates("instance, db", "metric = 'redis_commands_processed_total'"))
oracle("matched_errors", """SELECT cluster, kind, sum(v) AS value FROM samples
  WHERE metric = 'write_errors' AND kind IN ('readonly', 'master_down') GROUP BY ALL""", PROBE_SAMPLES)


def _now(metric: str, labels: str = "instance, redis_cluster", more: str = "") -> str:
    return f"""SELECT {labels}, arg_max(v, ts) AS value FROM samples
      WHERE metric = '{metric}' AND ts > (SELECT max(ts) FROM samples) - INTERVAL 7 DAY {more} GROUP BY ALL"""


oracle("nodes_up", _now("redis_up"), NODE_SAMPLES)
oracle("connected_clients", _now("redis_connected_clients"), NODE_SAMPLES)
oracle("memory_used", _now("redis_memory_used_bytes"), NODE_SAMPLES)
oracle("database_keys", _now("redis_db_keys", "instance, redis_cluster, db"), NODE_SAMPLES)
oracle("link_up", _now("redis_master_link_up"), NODE_SAMPLES)
oracle("nodes_up_of_version", _now(
    "redis_up", "instance, redis_cluster, redis_version_major", "AND redis_version_major = '8'"), NODE_SAMPLES)
oracle("keys_by_cluster", f"""SELECT redis_cluster, sum(value) AS value FROM
  ({_now("redis_db_keys", "instance, redis_cluster, db")}) GROUP BY ALL""", NODE_SAMPLES)
for _name, _on, _more in (("offset_lag", "instance, redis_cluster", ""), ("offset_lag_by_cluster", "redis_cluster", ", lefts")):
    oracle(_name, f"""SELECT r.instance, redis_cluster,
        CASE WHEN lefts = 1 THEN l.value - r.value END AS value {_more}
      FROM (SELECT {_on}, count(*) AS lefts, max(value) AS value FROM ({_now("redis_master_repl_offset")}) GROUP BY ALL) l
      JOIN ({_now("redis_slave_repl_offset")}) r USING ({_on})""",
           NODE_SAMPLES)
for _name in ("retained_samples", "stream_retained_samples"):
    oracle(_name, """SELECT metric, ts, v AS value FROM samples
  WHERE ts > (SELECT max(ts) FROM samples) - INTERVAL 2 DAY""", NODE_SAMPLES)
oracle("stored_samples", """SELECT metric, strftime(ts, '%Y-%m-%d') AS day, count(*) AS samples, sum(v) AS total
  FROM samples GROUP BY ALL""", NODE_SAMPLES)
oracle("counter_increase", """SELECT instance, date_trunc('day', ts)::TIMESTAMP AS ts,
  sum(CASE WHEN v >= prev THEN v - prev ELSE v END) AS increase
  FROM (SELECT *, lag(v) OVER (PARTITION BY instance, db ORDER BY ts) AS prev FROM samples
    WHERE metric = 'redis_commands_processed_total')
  WHERE prev IS NOT NULL GROUP BY ALL""", NODE_SAMPLES)
oracle("resampled", """
  SELECT instance, db, t AS ts, value FROM (
    SELECT g.instance, g.db, g.t, arg_max(v, s.ts) AS value, max(s.step) AS step
    FROM (SELECT instance, db, unnest(generate_series(lo, hi, INTERVAL 6 HOUR)) AS t FROM (
      SELECT instance, db, min(step) AS lo, max(step) AS hi FROM stepped GROUP BY instance, db)) g
    JOIN stepped s ON s.instance = g.instance AND s.db = g.db AND s.ts <= g.t GROUP BY g.instance, g.db, g.t)
  WHERE t <= step + INTERVAL 2 DAY""", NODE_SAMPLES, """
stepped AS (
  SELECT *, time_bucket(INTERVAL 6 HOUR, ts - INTERVAL 1 MICROSECOND) + INTERVAL 6 HOUR AS step
  FROM samples WHERE metric = 'redis_commands_processed_total')""")

# -- inventory and topology ------------------------------------------------------------------------

CONTAINERS = """
containers AS (
  SELECT *, role IN ('master', 'replica') AS plane FROM (
    SELECT k, printf('%012x', k) AS id, 'node-' || k AS name, role,
      CASE WHEN k % 29 = 0 THEN 0 WHEN k % 3 = 0 THEN 8 ELSE 6 END AS version,
      CASE WHEN k % 37 <> 0 THEN 6380 + k ELSE 0 END AS port,
      CASE WHEN role IN ('redis-exporter', 'prometheus', 'sentinel') THEN '' ELSE 'c' || (k % 25) END AS cluster,
      CASE WHEN k % 7 = 0 THEN 'Exited (0)' ELSE 'Up 5 minutes' END AS status, k % 31 <> 30 AS managed
    FROM (SELECT c_custkey AS k, CASE c_custkey % 20 WHEN 17 THEN 'redis-exporter' WHEN 18 THEN 'prometheus'
            WHEN 19 THEN 'client-enqueuer' WHEN 16 THEN 'client-workload' WHEN 15 THEN 'sentinel'
            ELSE CASE WHEN c_custkey < 25 THEN 'master' ELSE 'replica' END END AS role FROM customer))),
fleet AS (SELECT * FROM containers WHERE managed)"""
NODES = """
nodes AS (
  SELECT k, 'node-' || k AS name, 'c' || (k % 25) AS cluster, 6380 + k AS port, CASE WHEN k % 3 = 0 THEN 8 ELSE 6 END AS version,
    CASE WHEN k < 25 THEN 'master' WHEN seg = 'FURNITURE' THEN 'sentinel' WHEN seg = 'HOUSEHOLD' THEN 'client-workload'
         ELSE 'replica' END AS label, CASE WHEN k % 7 = 0 THEN 'Exited (0)' ELSE 'Up 5 minutes' END AS status,
    rep, CASE WHEN rep = 'slave' THEN CASE WHEN k % 4 = 0 THEN 6380 + k - 25 ELSE 6380 + k % 25 END ELSE 0 END AS rep_port,
    CASE WHEN rep = 'slave' THEN CASE WHEN k % 7 = 0 THEN 'down' ELSE 'up' END ELSE '' END AS rep_link,
    CASE WHEN k % 25 = 24 THEN 0 ELSE 6380 + k % 25 END AS leader
  FROM (SELECT c_custkey AS k, c_mktsegment AS seg, CASE WHEN c_custkey < 25 THEN 'master' WHEN c_custkey % 11 = 0 THEN NULL
          WHEN c_custkey % 11 = 1 THEN 'master' WHEN c_custkey % 11 = 2 THEN 'sync' ELSE 'slave' END AS rep FROM customer)),
plane AS (SELECT *, 
    CASE WHEN rep IS NULL THEN 'unreachable' WHEN rep = 'master' AND leader > 0 AND port <> leader THEN 'isolated'
         WHEN rep = 'slave' THEN 'replica' ELSE rep END AS live,
    CASE WHEN rep = 'slave' THEN '10.0.0.' || (k % 25) || ':' || rep_port || ' (' || rep_link || ')' ELSE '-' END AS follows
  FROM nodes WHERE label IN ('master', 'replica')),
mix AS (SELECT cluster, count(*) FILTER (WHERE version = 6) AS v6, count(*) FILTER (WHERE version <> 6) AS v8 FROM plane GROUP BY 1)"""

oracle("inventory", """SELECT id, name, role AS role_label, version::INT AS version, port, cluster, status FROM fleet""", CONTAINERS)
oracle("node_lookup", """SELECT id, name, role AS role_label, version::INT AS version, port, cluster, status FROM fleet
  WHERE name = 'node-7'""", CONTAINERS)
oracle("container_table", """SELECT name, role AS role_label, CASE WHEN version > 0 THEN version::VARCHAR ELSE '' END AS version,
  CASE WHEN port > 0 THEN port::VARCHAR ELSE '' END AS port, CASE WHEN cluster = '' THEN '-' ELSE cluster END AS cluster, status
  FROM fleet""", CONTAINERS)
oracle("probe_containers", """SELECT name, role AS role_label, CASE role WHEN 'client-workload' THEN 1 ELSE 2 END::BIGINT AS role_order,
  cluster, port FROM fleet WHERE role LIKE 'client-%'""", CONTAINERS)
oracle("cluster_instances", "SELECT name, role AS role_label, port FROM fleet WHERE plane AND cluster = 'c7'", CONTAINERS)
oracle("clusters", "SELECT DISTINCT cluster FROM fleet WHERE cluster <> ''", CONTAINERS)
oracle("removal_preview", """SELECT name, role AS role_label, concat_ws('  ',
  CASE WHEN version > 0 THEN 'v' || version || '  port=' || port END,
  CASE WHEN cluster <> '' THEN 'cluster=' || cluster END) AS detail FROM fleet""", CONTAINERS)
oracle("exporter_layout", """SELECT count(*) AS exporters, CASE WHEN count(*) = 0 THEN 'none' ELSE 'per node' END AS layout
  FROM fleet WHERE role = 'redis-exporter'""", CONTAINERS)
oracle("free_ports", """SELECT cluster, port, (turn % 3 + 1)::BIGINT AS slot
  FROM (SELECT port, row_number() OVER (ORDER BY port) - 1 AS turn FROM (SELECT unnest(range(6380, 6701)) AS port)
    WHERE port NOT IN (SELECT port FROM fleet WHERE port IS NOT NULL))
  JOIN (SELECT cluster, row_number() OVER (ORDER BY cluster NULLS FIRST) - 1 AS place FROM (SELECT DISTINCT cluster FROM fleet))
  ON turn // 3 = place""", CONTAINERS)
oracle("cluster_counts", "SELECT cluster, count(*) AS nodes FROM plane GROUP BY 1", NODES)
oracle("version_mix", "SELECT * FROM mix", NODES)
oracle("any_v6", "SELECT cluster, bool_or(version = 6) AS found FROM plane GROUP BY 1", NODES)
for _name, _by, _tail in (("quorum", "", ""), ("quorum_by_cluster", "cluster,", "GROUP BY cluster")):
    oracle(_name, f"""SELECT {_by} count(*) AS coordinators, count(*) // 2 + 1 AS quorum, count(*) % 2 = 0 AS even
      FROM nodes WHERE label = 'sentinel' {_tail}""", NODES)
oracle("first_states", """SELECT cluster, CASE WHEN arg_min(version, port) = 6 THEN 'AllV6' ELSE 'Done' END AS state
  FROM plane GROUP BY 1""", NODES)
oracle("replication_reports", """SELECT name, rep AS role,
  CASE WHEN rep IS NULL THEN NULL WHEN rep = 'slave' THEN '10.0.0.' || (k % 25) ELSE '' END AS master_host,
  CASE WHEN rep IS NOT NULL THEN rep_port END AS master_port, CASE WHEN rep IS NOT NULL THEN rep_link END AS link,
  CASE WHEN rep IS NOT NULL THEN rep_port END AS target,
  coalesce(rep = 'slave' AND rep_link = 'up' AND rep_port = 6380 + k % 25, false) AS synced FROM nodes""", NODES)
oracle("names", """SELECT name, 'fleet-' || cluster || '-' || port AS instance, 'fleet-sentinel-' || port AS coordinator,
  'fleet-workload-' || cluster AS probe, '10.0.0.1:' || port AS addr, 'redis://' || name || ':' || port AS uri,
  '__meta_docker_container_label_fleet_node_' || k AS label FROM nodes""", NODES)
oracle("port_ranges", """SELECT o_orderkey, CASE WHEN good THEN lo END AS lo, CASE WHEN good THEN hi END AS hi FROM (
  SELECT o_orderkey, 6380 + o_orderkey % 90 AS lo, 6380 + o_custkey % 150 AS hi,
    o_orderkey % 17 <> 0 AND o_orderkey % 90 < o_custkey % 150 AS good FROM orders)""")
oracle("durations", """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN n * 0.001::DOUBLE WHEN 1 THEN n WHEN 2 THEN n * 60
  WHEN 3 THEN n * 3600 WHEN 4 THEN n * 86400 WHEN 6 THEN n * 3600 + 1800 END::DOUBLE AS seconds
  FROM (SELECT o_orderkey, (o_orderkey % 90)::DOUBLE AS n FROM orders)""")

INSTANCES = """SELECT cluster, name, live AS role, 'v' || version AS ver, port, follows AS replicating_from,
  coalesce(rep = 'slave' AND leader > 0 AND rep_port <> leader, false) AS chained, status FROM plane"""
oracle("instance_table", INSTANCES, NODES)
oracle("instance_list", INSTANCES, NODES)
oracle("live_roles", "SELECT cluster, live AS role, count(*) AS nodes FROM plane GROUP BY ALL", NODES)
oracle("rewire_plan", """SELECT cluster, name, port, CASE WHEN rep IS NOT NULL THEN rep_port END AS current_port,
  CASE WHEN leader = 0 THEN 'no leader' WHEN port = leader THEN 'leader' WHEN rep IS NULL THEN 'skipped'
       WHEN rep_port = leader THEN 'direct' ELSE 'rewire' END AS action,
  CASE WHEN leader > 0 THEN 'node-' || (k % 25) END AS leader_name, leader AS leader_port FROM plane""", NODES)
PROMOTION = """SELECT cluster, name, port, version::INT AS version,
  CASE WHEN v6 > 0 AND v8 > 0 THEN CASE WHEN version = 6 THEN 100 ELSE 1 END END::INT AS priority, version <> 6 AS candidate
  FROM plane JOIN mix USING (cluster) WHERE leader > 0 AND port <> leader"""
oracle("promotion_plan", PROMOTION, NODES)
oracle("isolation_plan", "SELECT cluster, name, port FROM plane WHERE version = 6 AND port <> leader", NODES)

# -- lifecycle -------------------------------------------------------------------------------------

REPLAY = """
triggers AS (SELECT 'c' || o_custkey AS cluster, o_orderkey AS seq, o_orderdate AS ts, o_orderstatus <> 'P' AS ok,
  list_extract(['AddV8Instance', 'Failover', 'BreakReplication', 'DestroyV6', 'AddV8Sentinels', 'RemoveV6Sentinels'],
    1 + o_orderkey % 6) AS trig FROM orders),
states AS (
  SELECT cluster, list_reduce(list_prepend('AllV6', list(trig ORDER BY ts, seq)), lambda s, t: {step}) AS state
  FROM triggers WHERE ok GROUP BY cluster)""".replace("{step}", """CASE
    WHEN s = 'AllV6' AND t = 'AddV8Instance' THEN 'MixedVersions'
    WHEN s = 'MixedVersions' AND t = 'Failover' THEN 'FailoverComplete'
    WHEN s = 'FailoverComplete' AND t = 'BreakReplication' THEN 'ReplicationBroken'
    WHEN s = 'ReplicationBroken' AND t = 'DestroyV6' THEN 'V6Destroyed'
    WHEN s = 'V6Destroyed' AND t = 'AddV8Sentinels' THEN 'V8SentinelsAdded'
    WHEN s = 'V8SentinelsAdded' AND t = 'RemoveV6Sentinels' THEN 'Done' ELSE s END""")
PATH = """
path AS (SELECT * FROM (VALUES (0, 'AllV6', 'AddV8Instance', 'fleet instance add <cluster> --version=8'),
  (1, 'MixedVersions', 'Failover', 'fleet sentinel failover <cluster>'),
  (2, 'FailoverComplete', 'BreakReplication', 'fleet cluster isolate-v6-replicas <cluster>'),
  (3, 'ReplicationBroken', 'DestroyV6', 'fleet instance rm <last v6 instance>   (auto-advances)'),
  (4, 'V6Destroyed', 'AddV8Sentinels', 'fleet sentinel bootstrap --version=8'),
  (5, 'V8SentinelsAdded', 'RemoveV6Sentinels', 'fleet sentinel rm <last v6 sentinel>   (auto-advances)'),
  (6, 'Done', NULL, NULL)) t(position, state, trigger, command))"""
oracle("state_replay", "SELECT * FROM states", REPLAY)
oracle("stream_lifecycle", "SELECT * FROM states", REPLAY)
oracle("lifecycle_progress", """SELECT cluster, p.position::INT AS position, p.state,
  CASE WHEN p.position < c.position THEN 'done' WHEN p.position = c.position THEN 'current' ELSE 'pending' END AS mark,
  p.trigger, replace(p.command, '<cluster>', cluster) AS command, p.position = c.position AND p.trigger IS NOT NULL AS next
  FROM states s JOIN path c USING (state), path p""", REPLAY, PATH)
oracle("next_step", """SELECT cluster, state, trigger, replace(command, '<cluster>', cluster) AS command
  FROM states JOIN path USING (state) WHERE trigger IS NOT NULL""", REPLAY, PATH)
oracle("not_ready", "SELECT cluster, state FROM states WHERE state NOT IN ('V6Destroyed', 'Done')", REPLAY)
oracle("state_upsert", """SELECT cluster, list_reduce(list_prepend(state, list(trig ORDER BY ts, seq)), lambda s, t: {step}) AS state
  FROM states JOIN triggers USING (cluster) WHERE ok GROUP BY cluster, state"""
       .replace("{step}", REPLAY[REPLAY.index("CASE"):REPLAY.index(") AS state")]), REPLAY)
oracle("state_delete", "SELECT * FROM states WHERE cluster NOT IN (SELECT cluster FROM nodes)", REPLAY, NODES)
oracle("clusters_with_state", """SELECT cluster, coalesce(state, 'AllV6') AS state
  FROM (SELECT DISTINCT cluster FROM triggers) LEFT JOIN states USING (cluster)""", REPLAY)
oracle("derived_triggers", """SELECT cluster, state, trigger FROM (
  SELECT cluster, state, CASE WHEN state = 'AllV6' AND v8 > 0 THEN 'AddV8Instance'
    WHEN state = 'MixedVersions' AND l.version = 8 THEN 'Failover'
    WHEN state = 'ReplicationBroken' AND coalesce(v6, 0) = 0 THEN 'DestroyV6'
    WHEN state = 'V6Destroyed' THEN 'AddV8Sentinels' END AS trigger
  FROM states LEFT JOIN mix USING (cluster)
  LEFT JOIN (SELECT cluster, version FROM plane WHERE port = leader) l USING (cluster)) WHERE trigger IS NOT NULL""", REPLAY, NODES)
STATUS = "(SELECT count(*) FROM nodes WHERE label = 'sentinel')"
oracle("cluster_status", f"""SELECT i.*, coalesce(s.state, 'AllV6') AS state, coalesce(p.trigger, '') AS next_triggers,
  {STATUS} AS coordinators FROM ({INSTANCES}) i LEFT JOIN states s USING (cluster)
  LEFT JOIN path p ON p.state = coalesce(s.state, 'AllV6')""", REPLAY, NODES, PATH)
oracle("cluster_list", f"""SELECT cluster, version::INT AS version, instances, leader_port, {STATUS} AS coordinators,
  coalesce(state, 'AllV6') AS state FROM (
    SELECT cluster, arg_min(version, port) AS version, count(*) AS instances,
      CASE WHEN max(leader) > 0 THEN max(leader)::VARCHAR ELSE '-' END AS leader_port FROM plane GROUP BY cluster)
  LEFT JOIN states USING (cluster)""", REPLAY, NODES)

# -- coordinators ----------------------------------------------------------------------------------

ANSWERS = """
answers AS (
  SELECT *, ok AND port IS NOT NULL AS told FROM (
    SELECT TIMESTAMP '2024-01-01' + to_seconds(o_orderkey * 10) AS poll_ts, (o_orderkey % 3)::INT AS ord,
      'fleet-sentinel-' || CASE WHEN o_orderkey % 3 = 1 AND o_orderkey < 900 THEN 26370 WHEN o_orderkey % 3 = 0 AND o_orderkey < 300 THEN 26380
        ELSE 26379 + o_orderkey % 3 END AS coordinator, 'c' || (o_custkey % 25) AS cluster, o_orderstatus <> 'P' AS ok,
      CASE WHEN o_orderstatus = 'P' OR (o_orderkey % 5 <> 0 AND o_orderkey % 41 = 0) THEN '' ELSE 'c' || (o_custkey % 25) END AS name,
      CASE WHEN o_orderstatus = 'P' THEN '' ELSE '10.0.0.' || (o_custkey % 25) END AS ip,
      CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 29 <> 0 THEN 6380 + o_custkey % 25 + 25 * (o_orderkey // 40 % 3) END AS port
    FROM orders)),
aseen AS (SELECT ord, coordinator, max(poll_ts) AS to_ts FROM answers GROUP BY ALL),
ahere AS (SELECT ord, coordinator FROM aseen s WHERE to_ts > (SELECT max(to_ts) - INTERVAL 5 MINUTE FROM aseen)
  AND to_ts = (SELECT max(to_ts) FROM aseen o WHERE o.ord = s.ord) AND to_ts = (SELECT max(to_ts) FROM aseen o WHERE o.coordinator = s.coordinator)),
told_now AS (SELECT * FROM answers WHERE (ord, coordinator) IN (SELECT (ord, coordinator) FROM ahere) QUALIFY row_number() OVER (PARTITION BY cluster, ord ORDER BY poll_ts DESC) = 1),
leader_now AS (SELECT cluster, ip AS leader_host, port AS leader_port, ord AS told_by FROM told_now WHERE told
  QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY ord) = 1),
named AS (SELECT ord, coordinator, name, ip || ':' || coalesce(port, 0) AS address FROM told_now WHERE ok AND name <> ''),
moves AS (SELECT cluster, poll_ts, port, prev_port FROM (
    SELECT *, lag(port) OVER (PARTITION BY cluster ORDER BY poll_ts) AS prev_port FROM answers WHERE told)
  WHERE prev_port IS DISTINCT FROM port),
led AS (SELECT cluster, 'node-' || (port - 6380) AS node, poll_ts AS from_ts,
    lead(poll_ts) OVER (PARTITION BY cluster ORDER BY poll_ts) AS to_ts FROM moves)"""
LISTED = """
listed AS (
  SELECT *, CASE WHEN ip <> '' AND port <> 0 THEN ip || ':' || port END AS addr FROM (
    SELECT TIMESTAMP '2024-01-01' + to_seconds(l_orderkey * 10) AS poll_ts, (l_orderkey % 3)::INT AS ord,
      'fleet-sentinel-' || CASE WHEN l_orderkey % 3 = 1 AND l_orderkey < 900 THEN 26370 WHEN l_orderkey % 3 = 0 AND l_orderkey < 300 THEN 26380
        ELSE 26379 + l_orderkey % 3 END AS coordinator, 'c' || (l_orderkey % 25) AS cluster, l_orderkey % 10 <> 0 AS ok,
      CASE WHEN l_orderkey % 10 = 0 OR l_partkey % 50 = 0 THEN '' ELSE '10.0.1.' || (l_suppkey % 8) END AS ip,
      CASE WHEN l_orderkey % 10 <> 0 AND l_partkey % 50 <> 1 THEN 6380 + l_orderkey % 25 + 25 * (l_suppkey % 8) END AS port,
      CASE WHEN l_orderkey % 10 = 0 THEN 0 WHEN l_quantity > 25 THEN 100 ELSE 1 END::BIGINT AS priority
    FROM lineitem)),
good AS (SELECT DISTINCT cluster, poll_ts, addr FROM listed WHERE ok),
rounds AS (SELECT *, lead(poll_ts) OVER w AS next_ts, lag(poll_ts) OVER w AS prev_ts
  FROM (SELECT DISTINCT cluster, poll_ts FROM good) WINDOW w AS (PARTITION BY cluster ORDER BY poll_ts)),
lost AS (SELECT g.cluster, g.addr, r.next_ts AS gone_ts FROM good g JOIN rounds r USING (cluster, poll_ts)
  WHERE g.addr IS NOT NULL AND r.next_ts IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM good o WHERE o.cluster = g.cluster AND o.poll_ts = r.next_ts AND o.addr = g.addr)),
joined AS (SELECT g.cluster, g.addr, g.poll_ts AS ts FROM good g JOIN rounds r USING (cluster, poll_ts)
  WHERE g.addr IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM good o WHERE o.cluster = g.cluster AND o.poll_ts = r.prev_ts AND o.addr = g.addr)),
lseen AS (SELECT ord, coordinator, max(poll_ts) AS to_ts FROM listed GROUP BY ALL),
lhere AS (SELECT ord, coordinator FROM lseen s WHERE to_ts > (SELECT max(to_ts) - INTERVAL 5 MINUTE FROM lseen)
  AND to_ts = (SELECT max(to_ts) FROM lseen o WHERE o.ord = s.ord) AND to_ts = (SELECT max(to_ts) FROM lseen o WHERE o.coordinator = s.coordinator)),
last_now AS (SELECT * FROM listed WHERE (ord, coordinator) IN (SELECT (ord, coordinator) FROM lhere)
  QUALIFY poll_ts = max(poll_ts) OVER (PARTITION BY cluster, ord)),
first_now AS (SELECT * FROM last_now WHERE ok QUALIFY ord = min(ord) OVER (PARTITION BY cluster))"""
oracle("leader_answers", "SELECT poll_ts, ord, cluster, ok, name, ip, port, told FROM answers", ANSWERS)
oracle("followers", "SELECT poll_ts, ord, coordinator, cluster, ok, ip, port, priority, addr FROM listed", LISTED)
oracle("current_leader", "SELECT * FROM leader_now", ANSWERS)
oracle("masters_by_coordinator", "SELECT * FROM named", ANSWERS)
oracle("discovered_masters", "SELECT name, address FROM named WHERE ord = (SELECT min(ord) FROM told_now WHERE ok)", ANSWERS)
oracle("pick_leader", """SELECT name, address, name = 'c7' AS chosen, NULL::VARCHAR AS problem FROM named
  WHERE ord = (SELECT min(ord) FROM told_now WHERE ok)""", ANSWERS)
oracle("leader_changes", "SELECT * FROM moves", ANSWERS)
oracle("leader_intervals", "SELECT * FROM led", ANSWERS)
oracle("followers_observed", """SELECT cluster, poll_ts, count(addr) AS observed FROM good
  WHERE (cluster, poll_ts) IN (SELECT (cluster, max(poll_ts)) FROM good GROUP BY cluster) GROUP BY cluster, poll_ts""", LISTED)
oracle("vanished_followers", "SELECT * FROM lost", LISTED)
for _name in ("follower_changes", "stream_follower_changes"):
    oracle(_name, """SELECT cluster, addr, gone_ts AS ts, 'left' AS change FROM lost
      UNION ALL SELECT cluster, addr, ts, 'joined' FROM joined""", LISTED)
oracle("observed_samples", """SELECT 'probe_replicas_observed' AS metric, cluster AS labels, poll_ts AS ts,
  count(addr)::DOUBLE AS value FROM good
  WHERE (cluster, poll_ts) IN (SELECT (cluster, max(poll_ts)) FROM good GROUP BY cluster) GROUP BY cluster, poll_ts""", LISTED)
oracle("follower_addresses", "SELECT DISTINCT cluster, addr FROM listed WHERE addr IS NOT NULL", LISTED)
oracle("visible_followers", "SELECT cluster, port, name FROM plane WHERE (cluster, port) IN (SELECT (cluster, port) FROM first_now)",
       NODES, LISTED)
oracle("priority_convergence", f"""SELECT cluster, port, priority::BIGINT AS priority FROM ({PROMOTION}) p
  WHERE priority IS NOT NULL AND NOT EXISTS (SELECT 1 FROM first_now f WHERE f.cluster = p.cluster AND f.port = p.port
    AND f.priority = p.priority)""", NODES, LISTED)
oracle("removal_check", """SELECT name, cluster, port, reason IS NULL AS may_go, reason FROM (
  SELECT name, cluster, port, CASE WHEN label = 'sentinel' THEN 'coordinator' WHEN (cluster, port) IN
    (SELECT (cluster, port) FROM told_now WHERE told) THEN 'current leader' END AS reason FROM nodes)""", NODES, ANSWERS)
oracle("registration_plan", """SELECT cluster, leader_host, leader_port, leader_port IS NULL AS skipped, 2::BIGINT AS quorum,
  '26381' AS new_ports, '26379,26380' AS prior_ports FROM states LEFT JOIN (
    SELECT cluster, ip AS leader_host, port AS leader_port FROM told_now WHERE told AND ord < 2
    QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY ord) = 1) USING (cluster) WHERE state = 'V6Destroyed'""", REPLAY, ANSWERS)
oracle("quorum_plan", """SELECT name AS cluster, 2::BIGINT AS quorum, '26379,26380,26381' AS ports FROM named WHERE ord = 0""", ANSWERS)

# -- convergence -----------------------------------------------------------------------------------

COMMANDS = """SELECT c.ts, c.seq, c.node, c.cluster, c.line FROM (
  SELECT TIMESTAMP '2024-01-01' + to_seconds(l_orderkey * 10 + l_linenumber) AS ts, l_orderkey * 10 + l_linenumber AS seq,
    'node-' || (l_orderkey % 25 + 25 * (l_suppkey % 3)) AS node, 'c' || (l_orderkey % 25) AS cluster,
    '[0 10.0.0.1:6000] "SET" "k' || l_partkey || '"' AS line FROM lineitem) c
  JOIN led l ON l.cluster = c.cluster AND l.node = c.node AND c.ts >= l.from_ts AND (l.to_ts IS NULL OR c.ts < l.to_ts)"""
oracle("leader_commands", COMMANDS, ANSWERS)
oracle("stream_leader_commands", COMMANDS, ANSWERS)
probe("time_to_write", """SELECT cluster, id, ts, waited AS waited_us, waited IS NULL AS timed_out FROM (
  SELECT s.cluster, s.seq AS id, s.ts, (SELECT min(epoch_us(p.ts) - epoch_us(s.ts)) FROM log p WHERE p.cluster = s.cluster
    AND p.role = 'write' AND p.kind IS NULL AND p.ts >= s.ts AND p.ts <= s.ts + INTERVAL 30 MINUTE) AS waited
  FROM log s WHERE s.role = 'write' AND s.kind IS NOT NULL)""")
STARTS = """
starts AS (SELECT 'c' || (c_custkey % 25) AS cluster, 6380 + c_custkey AS port, c_custkey AS id,
  TIMESTAMP '2024-01-01' + to_minutes(c_custkey) AS ts FROM customer),
polls AS (SELECT 'c' || (o_custkey % 25) AS cluster, 6380 + o_custkey AS port, TIMESTAMP '2024-01-01' + to_seconds(o_orderkey * 10) AS at,
  o_orderstatus <> 'P' AS ready, o_orderstatus <> 'P' AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AS synced FROM orders)"""
for _name in ("ready", "synced"):
    oracle(f"time_to_{_name}", f"""SELECT cluster, port, id, ts, waited AS waited_us, waited IS NULL AS timed_out FROM (
      SELECT s.*, (SELECT min(epoch_us(p.at) - epoch_us(s.ts)) FROM polls p WHERE p.cluster = s.cluster AND p.port = s.port
        AND p.{_name} AND p.at >= s.ts AND p.at <= s.ts + INTERVAL 6 HOUR) AS waited FROM starts s)""", STARTS)
oracle("time_to_priorities", """SELECT cluster, id, ts, waited AS waited_us, waited IS NULL AS timed_out FROM (
  SELECT s.cluster, s.id, s.ts, (SELECT min(epoch_us(a.poll_ts) - epoch_us(s.ts)) FROM both_shown a WHERE a.cluster = s.cluster
    AND a.poll_ts >= s.ts AND a.poll_ts <= s.ts + INTERVAL 6 HOUR) AS waited FROM starts s)""", STARTS, LISTED, """
both_shown AS (
  SELECT cluster, poll_ts FROM (SELECT *, 6380 + CAST(substr(cluster, 2) AS BIGINT) AS base FROM listed WHERE ok)
  GROUP BY cluster, poll_ts HAVING bool_or(port = base + 25 AND priority = 100) AND bool_or(port = base + 50 AND priority = 1))""")
oracle("time_to_visible", """SELECT cluster, port, id, ts, waited AS waited_us, waited IS NULL AS timed_out FROM (
  SELECT s.*, (SELECT min(epoch_us(p.poll_ts) - epoch_us(s.ts)) FROM listed p WHERE p.cluster = s.cluster AND p.port = s.port
    AND p.ok AND p.poll_ts >= s.ts AND p.poll_ts <= s.ts + INTERVAL 10 MINUTE) AS waited
  FROM (SELECT 'c' || (o_orderkey % 25) AS cluster, 6380 + o_orderkey % 25 + 25 * (o_custkey % 8) AS port, o_orderkey AS id,
    TIMESTAMP '2024-01-01' + to_seconds(o_orderkey * 10) AS ts FROM orders) s)""", LISTED)
oracle("failover_outcome", """SELECT cluster, id, ts, old_port, promoted.port AS promoted_port,
  epoch_us(promoted.poll_ts) - epoch_us(ts) AS waited_us, promoted IS NULL AS timed_out FROM (
  SELECT q.*, (SELECT arg_min({'port': a.port, 'poll_ts': a.poll_ts}, a.poll_ts) FROM answers a WHERE a.told AND a.cluster = q.cluster
      AND a.poll_ts >= q.ts AND a.poll_ts <= q.ts + INTERVAL 10 MINUTE AND a.port IS DISTINCT FROM q.old_port
      AND (NOT EXISTS (SELECT 1 FROM plane n WHERE n.cluster = q.cluster AND n.version = 8 AND n.port IS DISTINCT FROM q.old_port)
           OR EXISTS (SELECT 1 FROM plane n WHERE n.cluster = q.cluster AND n.version = 8 AND n.port = a.port))) AS promoted
  FROM (SELECT r.*, o.port AS old_port FROM (
      SELECT 'c' || (o_custkey % 25) AS cluster, o_orderkey AS id, TIMESTAMP '2024-01-01' + to_seconds(o_orderkey * 10 + 5) AS ts FROM orders) r
    ASOF LEFT JOIN (SELECT * FROM answers WHERE told) o ON o.cluster = r.cluster AND o.poll_ts <= r.ts) q)""", NODES, ANSWERS)

# -- discovery -------------------------------------------------------------------------------------

TARGETS = """
jobs AS (
  SELECT 'redis-instances' AS job, 'fleet-redis-exporter:9121' AS address,
    CASE WHEN port > 0 THEN 'redis://' || name || ':' || port END AS param_target,
    CASE WHEN port > 0 THEN 'redis://' || name || ':' || port ELSE 'fleet-redis-exporter:9121' END AS instance,
    name AS redis_instance, cluster AS redis_cluster, CASE WHEN version = 0 THEN 'six' ELSE version::VARCHAR END AS redis_version_major,
    NULL::VARCHAR AS workload_cluster FROM fleet WHERE plane
  UNION ALL
  SELECT 'workload', '172.18.' || substr(id, 9, 4) || ':9300', NULL, '172.18.' || substr(id, 9, 4) || ':9300', NULL, NULL, NULL, cluster
  FROM containers WHERE role = 'client-workload')"""
oracle("scrape_targets", "SELECT * FROM jobs", CONTAINERS, TARGETS)
oracle("relabelled_targets", """SELECT label, count(value) AS targets, count(DISTINCT value) AS values FROM (
    SELECT unnest(['__address__', '__param_target', 'instance', 'redis_instance', 'redis_cluster', 'redis_version_major',
        '__meta_docker_network_name', '__meta_docker_network_ip', '__meta_docker_container_label_fleet_target_port',
        '__meta_docker_container_label_fleet_managed', '__meta_docker_container_label_fleet_role',
        '__meta_docker_container_label_fleet_cluster', '__meta_docker_container_label_fleet_version',
        '__meta_docker_container_label_fleet_port', '__meta_docker_container_label_fleet_name']) AS label,
      unnest(['fleet-redis-exporter:9121', uri, uri, name, cluster, v, 'fleet', '172.18.' || substr(id, 9, 4), '9300',
        CASE WHEN managed THEN 'true' ELSE 'false' END, role, cluster, v, CASE WHEN port > 0 THEN port::VARCHAR END, name]) AS value
    FROM (SELECT *, CASE WHEN version = 0 THEN 'six' ELSE version::VARCHAR END AS v,
        CASE WHEN port > 0 THEN 'redis://' || name || ':' || port END AS uri FROM containers WHERE plane))
  WHERE value IS NOT NULL GROUP BY label""", CONTAINERS)
oracle("stored_states", "SELECT * FROM states", REPLAY)
oracle("stored_clusters", "SELECT cluster FROM states", REPLAY)
ORACLES["stored_probe_log"] = ORACLES["op_counts"]
oracle("stored_targets", "SELECT job, redis_version_major, count(*) AS targets FROM jobs WHERE job = 'redis-instances' GROUP BY ALL", CONTAINERS, TARGETS)
oracle("version_groups", """SELECT cluster, CASE WHEN version = 6 THEN 'v6' ELSE 'v8' END AS version_group, count(*) AS nodes
  FROM plane GROUP BY ALL""", NODES)
LINES = """SELECT 'c' || (l_orderkey % 25) AS cluster, 'node-' || (l_orderkey % 25 + 25 * (l_suppkey % 3)) AS node,
    '[0 10.0.0.1:6000] "SET" "k' || l_partkey || '"' AS line FROM lineitem"""
ORACLES["stream_command_lines"] = f"SELECT cluster, node, count(*) AS lines, count(DISTINCT line) AS distinct_lines FROM ({LINES}) GROUP BY ALL"
ORACLES["printed_commands"] = f"SELECT line, count(*) AS times FROM ({LINES}) GROUP BY ALL"
ORACLES["stream_cadence"] = "SELECT 'probe' AS cadence, '200 milliseconds' AS every, true AS several_batches, count(*) AS rows FROM events"
