"""Edge rows of the operators, with results worked out by hand."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetpulse.operators import convergence, lifecycle, probes, rates, relabel
from fleetpulse.operators import topology as topo
from fleetpulse.plans import reports
from fleetpulse.sources import driver_tables, readers, schemas, writers
from conftest import FOLDER

T0 = datetime(2024, 1, 1)
SMALL = "/root/testdata/sf0.01"


def at(s):
    return T0 + timedelta(seconds=s)


def ns(s):
    return int((at(s) - datetime(1970, 1, 1)).total_seconds()) * 10**9


def log_of(spark, rows):
    """Rows as (second, role, replica, raw or error, duration)."""
    full = [
        (i, at(s), "c", role, rep, dur, None if raw is None or ":" in raw else raw, False, raw if raw and ":" in raw else None)
        for i, (s, role, rep, raw, dur) in enumerate(rows)
    ]
    return spark.createDataFrame(full, schemas.PROBE_LOG)


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# -- probes --------------------------------------------------------------------------------------


def test_lag_rules(spark):
    log = log_of(spark, [
        (0, "replica_read", "r", f"1:{ns(0)}", 0.1),       # before any leader read: no row
        (1, "master_read", None, f"0:{ns(1)}", 0.1),
        (2, "replica_read", "r", f"0:{ns(1)}", 0.1),       # leader value not above 0: no row
        (3, "master_read", None, f"10:{ns(3)}", 0.1),
        (4, "replica_read", "r", f"7:{ns(2)}", 0.1),       # behind
        (5, "replica_read", "r", f"12:{ns(5)}", 0.1),      # ahead: negative, kept
        (6, "master_read", None, "redis: nil", 0.1),       # no value: the last one stays
        (7, "replica_read", "r", f"9:{ns(2)}", 0.1),
        (8, "master_read", None, f"4:{ns(8)}", 0.1),       # fell: last, not highest
        (8, "replica_read", "r", f"3:{ns(2)}", 0.1),       # same instant: by seq
        (9, "master_read", None, f"-2:{ns(9)}", 0.1),
        (10, "replica_read", "r", f"1:{ns(2)}", 0.1),      # not above 0 again: the gauge keeps its value
    ])
    assert rows_of(probes.replica_lag(log), "seq", "lag") == [(4, 3), (5, -2), (7, 1), (9, 1)]
    assert rows_of(probes.lag_gauge(log), "replica", "lag") == [("r", 1)]


def test_overflowing_values_do_not_fail(spark):
    log = log_of(spark, [(0, "master_read", None, f"{2**63 - 1}:{-2**63}", 0.1), (1, "replica_read", "r", "-5:0", 0.1)])
    assert rows_of(probes.replica_lag(log), "lag") == [(None,)]


def test_histogram_bounds(spark):
    log = log_of(spark, [(0, "write", None, "1:1", d) for d in (0.0005, 1.024, 5.0)])
    got = {r.le: r.cum for r in probes.latency_histogram(log).collect()}
    assert len(got) == 13 and got[0.0005] == 1 and got[0.512] == 1 and got[1.024] == 2 and got[float("inf")] == 3


def test_histogram_properties(spark):
    log = driver_tables.probe_log(spark, FOLDER)
    ops = probes.op_counts(log).groupBy("cluster", "role", "replica").agg(F.sum("ops").alias("ops"))
    hist = probes.latency_histogram(log).groupBy("cluster", "role", "replica", "count").agg(
        F.array_sort(F.collect_list(F.struct("le", "cum"))).alias("b"))
    for r in hist.collect():
        cums = [x.cum for x in r.b]
        assert cums == sorted(cums) and cums[-1] == r["count"]
    assert ops.agg(F.sum("ops")).first()[0] == log.count() == hist.agg(F.sum("count")).first()[0]


def test_missing_key_is_ok_without_a_value(spark):
    log = log_of(spark, [(0, "master_read", None, "redis: nil", 0.1)])
    assert rows_of(probes.op_counts(log), "status", "ops") == [("ok", 1)]
    assert probes.error_counts(log).count() == 0 and probes.value_gauges(log).count() == 0


def test_removal_forgets_gauges(spark):
    g = spark.createDataFrame([("c", "a", at(1), 1, 5), ("c", "b", at(1), 2, 6), ("c", "b", at(9), 3, 7)],
                              "cluster string, replica string, ts timestamp_ntz, seq int, lag int")
    gone = spark.createDataFrame([("c", "a", at(5)), ("c", "b", at(5))], "cluster string, replica string, gone_ts timestamp_ntz")
    got = probes.latest_present(g, gone, ["cluster", "replica"], ["lag"], probes.ORDER)
    assert rows_of(got, "replica", "lag") == [("b", 7)]


def test_follower_sets(spark):
    rows = [("c", at(0), "a", True), ("c", at(0), "b", True), ("c", at(10), None, False), ("c", at(20), "a", True),
            ("c", at(20), "a", True), ("c", at(30), None, True), ("c", at(40), "b", True), ("c", at(50), None, False)]
    f = spark.createDataFrame(rows, "cluster string, poll_ts timestamp_ntz, addr string, ok boolean")
    assert rows_of(probes.followers_observed(f), "cluster", "observed") == [("c", 1)]
    assert rows_of(probes.vanished_followers(f), "addr", "gone_ts") == [("a", at(30)), ("b", at(20))]
    assert rows_of(probes.follower_changes(f).where("change = 'joined'"), "addr", "ts") == [
        ("a", at(0)), ("b", at(0)), ("b", at(40))]


def test_follower_sets_by_brute_force(spark):
    rng = random.Random(4)
    polls = {(c, t): (rng.random() < 0.85, [a for a in "abcde" if rng.random() < 0.5]) for c in "xy" for t in range(60)}
    rows = [(c, at(t), a, ok) for (c, t), (ok, addrs) in polls.items() for a in addrs or [None]]
    want = set()
    for c in "xy":
        good = [(t, set(addrs)) for (k, t), (ok, addrs) in sorted(polls.items()) if k == c and ok]
        for (_, old), (t, new) in zip([(None, set()), *good], good):
            want |= {(c, a, at(t), "left") for a in old - new} | {(c, a, at(t), "joined") for a in new - old}
    f = spark.createDataFrame(rows, "cluster string, poll_ts timestamp_ntz, addr string, ok boolean")
    found = probes.follower_changes(f).select("cluster", "addr", "ts", "change").collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_gauges_with_lag_are_the_gauges_and_the_lag(spark, limits):
    log = driver_tables.probe_log(spark, FOLDER)
    gauges = lambda df: rows_of(df, "cluster", "role", "replica", "n", "age_ns")
    for limit in (10**6, 50):
        limits(rowsPerTask=limit)
        both = probes.gauges_with_lag(log)
        assert gauges(both) == gauges(probes.value_gauges(log))
        assert rows_of(both.where("lags"), "cluster", "replica", "lag") == rows_of(probes.lag_gauge(log), "cluster", "replica", "lag")


# -- rates ---------------------------------------------------------------------------------------


def test_rate_windows(spark):
    # 15 s samples; a restart between 30 and 45.
    rows = [("s", at(t), v) for t, v in [(0, 10.0), (15, 20.0), (30, 40.0), (45, 5.0), (60, 8.0), (200, 9.0)]]
    s = spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double")
    got = {r.ts: r.rate for r in rates.rate(s, ["k"]).collect()}
    assert got[at(15)] == pytest.approx(10 / 60)
    assert got[at(45)] == pytest.approx((10 + 20 + 5) / 60)
    # The window is open on the left: the sample at 0 is out.
    assert got[at(60)] == pytest.approx((20 + 5 + 3) / 60)
    # At 105 only the sample at 60 is left: no pair, no row. Nor is there one across a gap longer than the window.
    assert at(90) in got and at(105) not in got and at(210) not in got


def test_rate_carried_on_to_the_edges(spark):
    # 5 a second, read every 15 s: four samples and 45 s of increase lie in a window of 60 s.
    rows = [("s", at(t), 1000.0 + 5 * t) for t in range(0, 300, 15)]
    s = spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double")
    plain = {r.ts: r.rate for r in rates.rate(s, ["k"]).collect()}
    whole = {r.ts: r.rate for r in rates.rate(s, ["k"], extrapolate=True).collect()}
    assert plain[at(150)] == pytest.approx(3.75) and whole[at(150)] == pytest.approx(5.0)
    # A counter that began at 0 is not carried on to before that: 20 s from 0 to 10, then 40 s at most half a distance.
    young = spark.createDataFrame([("s", at(40), 0.0), ("s", at(60), 10.0)], "k string, ts timestamp_ntz, value double")
    assert {r.ts: r.rate for r in rates.rate(young, ["k"], extrapolate=True).collect()}[at(60)] == pytest.approx(10 / 60)


def test_rates_are_taken_per_series(spark):
    from fleetpulse.plans import health

    rows = [("probe_writes_total", {"status": "ok", "workload_cluster": c, "instance": p}, at(t), base + t / 15)
            for c in ("a", "b") for p, base in (("p", 100.0), ("q", 9000.0)) for t in range(0, 120, 15)]
    s = spark.createDataFrame(rows, schemas.METRIC_SAMPLE)
    got = {(r.cluster, r.ts): r.rate for r in health.writes_per_second(s).collect()}
    assert got["a", at(105)] == got["b", at(105)] == pytest.approx(2 / 15)


def test_label_order_and_empty_labels_do_not_make_a_series(spark):
    rows = [("m", {"a": "1", "b": "2"}, at(0), 1.0), ("m", {"b": "2", "a": "1", "c": ""}, at(1), 2.0),
            ("m", {"a": "1"}, at(1), 3.0), ("m", None, at(1), 4.0), ("m", {}, at(0), 5.0)]
    s = spark.createDataFrame(rows, schemas.METRIC_SAMPLE)
    assert {tuple(r) for r in rates.instant(s, "m", ["a"]).collect()} == {(None, 4.0), ("1", 2.0), ("1", 3.0)}


def test_a_series_without_a_recent_sample_is_gone(spark):
    rows = [("m", {"a": "old"}, at(0), 1.0), ("m", {"a": "new"}, at(3600), 2.0)]
    s = spark.createDataFrame(rows, schemas.METRIC_SAMPLE)
    assert rows_of(rates.instant(s, "m", ["a"]), "a", "value") == [("new", 2.0)]
    assert rows_of(rates.instant(s, "m", ["a"], at=at(200)), "a", "value") == [("old", 1.0)]
    assert rates.instant(s, "m", ["a"], at=at(300)).count() == 0  # open on the left
    assert rates.instant(s, "m", ["a"], "2h").count() == 2


def test_increase_with_resets(spark):
    rows = [("s", at(t), v) for t, v in [(0, 3.0), (10, 5.0), (20, 1.0), (30, 1.0), (40, 4.0)]]
    s = spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double")
    assert rates.increase(s, ["k"], "day").first().increase == 2 + 1 + 0 + 3


def test_resample_fills_gaps(spark):
    rows = [("s", at(t), v) for t, v in [(1, 1.0), (14, 2.0), (15, 3.0), (50, 4.0)]]
    s = spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double")
    assert rows_of(rates.resample(s, ["k"]), "ts", "value") == [
        (at(15), 3.0), (at(30), 3.0), (at(45), 3.0), (at(60), 4.0)]


def test_match_is_anchored(spark):
    df = spark.createDataFrame([("readonly",), ("readonly\n",), ("xreadonly",), (None,)], "kind string")
    assert rows_of(rates.match(df, "kind", "=~", "readonly|loading"), "kind") == [("readonly",)]
    assert rates.match(df, "kind", "=~", "x?.*").count() == 3
    assert rates.match(df, "kind", "=", "").count() == 1


def test_op_rate_needs_whole_steps(spark):
    with pytest.raises(ValueError):
        rates.op_rate(log_of(spark, [(0, "write", None, "1:1", 0.1)]), ["cluster"], "50s", "15s")


def test_retention(spark):
    df = spark.createDataFrame([(at(0),), (at(3600),), (at(7200),)], "ts timestamp_ntz")
    assert rows_of(rates.retain(df), "ts") == [(at(3600),), (at(7200),)]


def test_offset_lag_needs_both_sides(spark):
    rows = [("a_repl", {"i": "1"}, at(0), 5.0), ("a_repl", {"i": "2"}, at(0), 9.0), ("b_repl", {"i": "1"}, at(1), 3.0)]
    s = spark.createDataFrame(rows, schemas.METRIC_SAMPLE)
    assert rows_of(rates.subtract(s, "a_repl", "b_repl", ["i"]), "i", "value") == [("1", 2.0)]


def test_one_leader_against_each_follower(spark):
    def sample(metric, cluster, node, value):
        return (metric, {"cluster": cluster, "node": node}, at(0), value)

    rows = [sample("lead", "a", "1", 100.0), sample("follow", "a", "2", 90.0), sample("follow", "a", "3", 10.0),
            sample("lead", "b", "1", 5.0), sample("lead", "b", "2", 6.0), sample("follow", "b", "3", 1.0),
            sample("follow", "c", "1", 1.0)]
    s = spark.createDataFrame(rows, schemas.METRIC_SAMPLE)
    got = rates.subtract(s, "lead", "follow", ["cluster"], ["cluster", "node"])
    assert {tuple(r) for r in got.collect()} == {("a", "2", 10.0, 1), ("a", "3", 90.0, 1), ("b", "3", None, 2)}


# -- topology ------------------------------------------------------------------------------------


def test_documented_instance_table(spark):
    def node(port, version, role, target=None, link=None):
        text = f"role:{role}\r\n" + (f"master_host:fleet-mc-{target}\r\nmaster_port:{target}\r\nmaster_link_status:{link}\r\n" if target else "")
        return (f"fleet-mc-{port}", "mc", "replica", "Up 5 minutes", version, port, text)

    nodes = spark.createDataFrame(
        [node(6380, 6, "slave", 6384, "up"), node(6381, 6, "slave", 6384, "up"), node(6382, 6, "master"),
         node(6383, 8, "slave", 6384, "up"), node(6384, 8, "master"), node(6385, 8, "slave", 6384, "down")],
        schemas.NODE_SNAPSHOT)
    leaders = spark.createDataFrame([("mc", 6384)], "cluster string, leader_port bigint")
    got = [tuple(r) for r in reports.instance_list(nodes, leaders, "mc").select("role", "ver", "port", "replicating_from").collect()]
    up = "fleet-mc-6384:6384 (up)"
    assert got == [("replica", "v6", 6380, up), ("replica", "v6", 6381, up), ("isolated", "v6", 6382, "-"),
                   ("replica", "v8", 6383, up), ("master", "v8", 6384, "-"),
                   ("replica", "v8", 6385, "fleet-mc-6384:6384 (down)")]


def test_counts_of_the_small_tables(spark):
    nodes, leaders = driver_tables.node_snapshot(spark, SMALL), driver_tables.leaders_told(spark, SMALL)
    roles = reports.live_roles(nodes, leaders).groupBy("role").agg(F.sum("nodes"))
    assert rows_of(roles, "*") == [("isolated", 75), ("master", 28), ("replica", 656), ("sync", 73), ("unreachable", 88)]
    actions = reports.rewire_plan(nodes, leaders).groupBy("action").count()
    assert rows_of(actions, "*") == [("direct", 465), ("leader", 24), ("no leader", 37), ("rewire", 310), ("skipped", 84)]
    assert reports.isolation_plan(nodes, leaders).count() == 608


@pytest.mark.parametrize("n, quorum", [(1, 1), (2, 2), (3, 2), (4, 3), (5, 3), (6, 4)])
def test_quorum(spark, n, quorum):
    row = topo.quorum(spark.range(n)).first()
    assert (row.quorum, row.even) == (quorum, n % 2 == 0) and 2 * row.quorum > n


def test_inventory_parsing(spark):
    rows = [("1", ["/n1", "/alias"], {"fleet.managed": "true", "fleet.port": "x"}, "Up"),
            ("2", ["n2"], {"fleet.managed": "true", "fleet.version": "8", "fleet.port": "5"}, "Up"),
            ("3", ["/n3"], {}, "Up")]
    got = topo.nodes(spark.createDataFrame(rows, schemas.NODE_LABELS))
    assert rows_of(got, "name", "version", "port", "cluster") == [("n1", 0, 0, ""), ("n2", 8, 5, "")]
    table = topo.container_table(got)
    assert rows_of(table, "version", "port", "cluster") == [("", "", "-"), ("8", "5", "-")]
    assert topo.node(got, "nobody").count() == 0


def test_missing_leader_node(spark):
    nodes = spark.createDataFrame([("n", "c", "replica", "Up", 6, 1, None)], schemas.NODE_SNAPSHOT)
    leaders = spark.createDataFrame([("c", 9)], "cluster string, leader_port bigint")
    assert reports.rewire_plan(nodes, leaders).first().action == "leader without node"


def test_free_slots(spark):
    used = spark.createDataFrame([("g", 1), ("g", 2), ("g", 4), ("g", 19), ("h", 7), ("i", None), ("j", 5), (None, 6)],
                                 "g string, port bigint")
    # 3, 8, 9, 10 and 11 are free, for the groups in their order; the last gets none.
    assert {tuple(r) for r in topo.free_slots(used, ["g"], 1, 11, 2).collect()} == {
        (None, 3, 1), (None, 8, 2), ("g", 9, 1), ("g", 10, 2), ("h", 11, 1)}
    assert topo.free_slots(used, ["g"], 4, 7, 2).count() == 0
    with pytest.raises(ValueError):
        topo.free_slots(used, ["g"], 5, 5, 1)


@pytest.mark.parametrize("names, layout", [([], "none"), (["fleet-redis-exporter"], "shared"), (["old-1"], "per node"),
                                           (["fleet-redis-exporter", "old-1"], "per node")])
def test_exporter_layout(spark, names, layout):
    nodes = spark.createDataFrame([(n, "redis-exporter") for n in names] + [("x", "master")], "name string, role_label string")
    assert reports.exporter_layout(nodes).first().layout == layout


def view_of(spark, rows):
    """Rows as (second, ord, cluster, ok, port or None)."""
    return spark.createDataFrame(
        [(at(s), o, f"fleet-sentinel-{o}", 6, c, "master", ok, ["name", c, "ip", "h", "port", str(p)] if ok else None)
         for s, o, c, ok, p in rows], schemas.COORDINATOR_VIEW)


def test_first_answer_wins(spark):
    view = view_of(spark, [(0, 0, "c", True, 1), (5, 0, "c", False, None), (1, 1, "c", True, "x"), (2, 2, "c", True, 3), (9, 3, "c", True, 4)])
    assert rows_of(topo.current_leader(view), "cluster", "leader_port", "told_by") == [("c", 3, 2)]
    assert topo.current_leader(view_of(spark, [(0, 0, "c", False, None)])).count() == 0


def test_pick_leader(spark):
    two = spark.createDataFrame([("a", "h:1"), ("b", "h:2")], "name string, address string")
    assert rows_of(topo.pick_leader(two, "a"), "name", "chosen", "problem") == [("a", True, None), ("b", False, None)]
    assert {r.problem for r in topo.pick_leader(two, "z").collect()} == {"no such leader: z"}
    assert {r.problem for r in topo.pick_leader(two).collect()} == {"several leaders, choose one by name"}
    assert rows_of(topo.pick_leader(two.where("name = 'a'")), "chosen", "problem") == [(True, None)]


def test_unmet(spark):
    want = spark.createDataFrame([(1, 100), (2, 1)], "port int, priority int")
    seen = spark.createDataFrame([(1, 100), (2, 100), (3, 1)], "port int, priority int")
    assert rows_of(topo.unmet(want, seen, ["port", "priority"]), "port") == [(2,)]


# -- lifecycle -----------------------------------------------------------------------------------


def triggers_of(spark, rows):
    return spark.createDataFrame([(i, at(i), c, t, ok) for i, (c, t, ok) in enumerate(rows)], schemas.TRIGGER_LOG)


def test_replay_rules(spark, limits):
    t = triggers_of(spark, [("a", "Failover", True), ("b", "AddV8Instance", False), ("c", "AddV8Instance", True),
                            ("c", "AddV8Instance", True), ("c", "Failover", True), ("d", "nonsense", True), ("d", "AddV8Instance", True)])
    want = [("a", "AllV6"), ("c", "FailoverComplete"), ("d", "MixedVersions")]
    assert rows_of(lifecycle.replay(t), "*") == want
    limits(foldRows=1)
    assert rows_of(lifecycle.replay(t), "*") == want
    start = spark.createDataFrame([("c", "Done"), ("a", "MixedVersions")], "cluster string, state string")
    assert rows_of(lifecycle.replay(t, start), "*") == [("a", "FailoverComplete"), ("c", "Done"), ("d", "MixedVersions")]


def test_replay_of_the_small_tables(spark):
    t = driver_tables.trigger_log(spark, SMALL).withColumn("ok", F.lit(True))
    clusters = spark.read.parquet(f"{SMALL}/customer.parquet").select(F.concat(F.lit("c"), "c_custkey").alias("cluster"))
    got = lifecycle.with_state(clusters, lifecycle.replay(t)).groupBy("state").count()
    assert dict(rows_of(got, "*")) == {
        "AllV6": 273, "MixedVersions": 464, "FailoverComplete": 404, "ReplicationBroken": 219, "V6Destroyed": 105,
        "V8SentinelsAdded": 22, "Done": 13}


def test_state_order(spark):
    got = [r.state for r in lifecycle.state_order(spark).orderBy("depth").collect()]
    assert got == ["AllV6", "MixedVersions", "FailoverComplete", "ReplicationBroken", "V6Destroyed", "V8SentinelsAdded", "Done"]


def test_progress_of_an_unknown_state(spark):
    states = spark.createDataFrame([("a", "Done"), ("b", "Odd")], "cluster string, state string")
    got = reports.lifecycle_progress(states)
    assert rows_of(got.where("cluster = 'b'"), "state", "mark", "next") == [("Odd", "unknown", False)]
    assert got.where("cluster = 'a'").count() == 7 and got.where("next").count() == 0
    assert rows_of(reports.next_step(states), "cluster") == []


def test_derived_triggers(spark):
    nodes = spark.createDataFrame(
        [(f"{c}{i}", c, "replica", "Up", v, 10 + i, None)
         for c, versions in {"a": [6, 8], "b": [6, 6], "m": [6, 8], "n": [6, 8], "r": [8], "s": [6, 8]}.items()
         for i, v in enumerate(versions)], schemas.NODE_SNAPSHOT)
    leaders = spark.createDataFrame([("m", 11), ("n", 10)], "cluster string, leader_port bigint")
    states = spark.createDataFrame(
        [("a", "AllV6"), ("b", "AllV6"), ("m", "MixedVersions"), ("n", "MixedVersions"), ("r", "ReplicationBroken"),
         ("s", "ReplicationBroken"), ("x", "V6Destroyed"), ("y", "V8SentinelsAdded"), ("z", "Done")],
        "cluster string, state string")
    only_v8 = spark.createDataFrame([(0, "q", 8, 1)], "ord int, coordinator string, version int, port bigint")
    got = reports.derived_triggers(nodes, leaders, only_v8, states)
    assert rows_of(got, "cluster", "trigger") == [
        ("a", "AddV8Instance"), ("m", "Failover"), ("r", "DestroyV6"), ("x", "AddV8Sentinels"), ("y", "RemoveV6Sentinels")]
    none = reports.derived_triggers(nodes, leaders, only_v8.where("false"), states)
    assert ("x", "AddV8Sentinels") not in rows_of(none, "cluster", "trigger")


def test_state_files(spark, tmp_path):
    (tmp_path / "a.b.json").write_text('{\n  "state": "Done"\n}')
    (tmp_path / "c.json").write_text('{"state": "AllV6"}')
    (tmp_path / "notes.txt").write_text("no")
    states = readers.read_states(spark, str(tmp_path))
    assert rows_of(states, "*") == [("a.b", "Done"), ("c", "AllV6")]
    assert rows_of(readers.state_clusters(states), "*") == [("a.b",), ("c",)]
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception, match="MALFORMED|FAILED"):
        readers.read_states(spark, str(tmp_path)).collect()


def test_state_table_changes(spark, tmp_path):
    now = spark.createDataFrame([("a", "AllV6"), ("b", "Done")], "cluster string, state string")
    change = spark.createDataFrame([("a", "MixedVersions"), ("n", "AllV6")], "cluster string, state string")
    after = lifecycle.upsert_states(now, change)
    writers.write_states(after, str(tmp_path / "s1"))
    stored = spark.read.parquet(str(tmp_path / "s1"))
    assert rows_of(stored, "cluster", "state") == [("a", "MixedVersions"), ("b", "Done"), ("n", "AllV6")]
    gone = spark.createDataFrame([("b",), ("nobody",)], "cluster string")
    assert rows_of(lifecycle.drop_states(stored, gone), "cluster") == [("a",), ("n",)]


# -- convergence ---------------------------------------------------------------------------------


def test_time_to_is_cut_at_the_limit(spark):
    starts = spark.createDataFrame([("c", at(0), 1), ("c", at(10), 2), ("c", at(41), 3), ("d", at(0), 4)], "cluster string, ts timestamp_ntz, id bigint")
    polls = spark.createDataFrame([("c", at(10)), ("c", at(71)), ("d", at(31))], "cluster string, ts timestamp_ntz")
    got = convergence.time_to(starts, polls, ["cluster"], convergence.LIMITS["ready"])
    assert rows_of(got, "id", "waited_us", "timed_out") == [(1, 10**7, False), (2, 0, False), (3, 3 * 10**7, False), (4, None, True)]


def test_failover_skips_leaders_that_do_not_count(spark):
    nodes = spark.createDataFrame([(f"n{p}", "c", "replica", "Up", v, p, None) for p, v in ((1, 6), (2, 8), (3, 8), (4, 6))], schemas.NODE_SNAPSHOT)
    view = view_of(spark, [(0, 0, "c", True, 2), (10, 0, "c", True, 1), (20, 0, "c", True, 2), (30, 0, "c", True, 4), (40, 0, "c", True, 3)])
    asked = spark.createDataFrame([("c", at(5), 1), ("c", at(15), 2), ("c", at(45), 3)], "cluster string, ts timestamp_ntz, id bigint")
    got = convergence.failover_outcome(asked, view, nodes)
    # From port 2: 1 is v6, 2 is the old leader, 4 is v6, so 3.
    assert rows_of(got, "id", "old_port", "promoted_port", "waited_us", "timed_out") == [
        (1, 2, 3, 35 * 10**6, False), (2, 1, 2, 5 * 10**6, False), (3, 3, None, None, True)]
    # Without another v8 node any new leader counts.
    only_v6 = nodes.where("version = 6")
    assert rows_of(convergence.failover_outcome(asked, view, only_v6), "id", "promoted_port") == [(1, 1), (2, 2), (3, None)]


def test_commands_follow_the_leader(spark, limits):
    intervals = spark.createDataFrame([("c", "a", at(0), at(10)), ("c", "b", at(10), None)],
                                      "cluster string, node string, from_ts timestamp_ntz, to_ts timestamp_ntz")
    commands = spark.createDataFrame(
        [(at(-1), 0, "a", "c", "early"), (at(0), 1, "a", "c", "1"), (at(9), 2, "b", "c", "no"), (at(10), 3, "a", "c", "no"),
         (at(10), 4, "b", "c", "2"), (at(99), 5, "b", "c", "3"), (at(99), 6, "b", "d", "no")], schemas.COMMAND_LOG)
    want = [("1",), ("2",), ("3",)]
    assert rows_of(convergence.leader_commands(commands, intervals), "line") == want
    limits(broadcastRows=1)
    assert rows_of(convergence.leader_commands(commands, intervals), "line") == want


# -- relabelling ---------------------------------------------------------------------------------


def test_relabel_rules(spark):
    rows = [({"a": "x", "b": "1", "gone": "y"},), ({"a": "xy"},), ({"b": "2"},)]
    df = spark.createDataFrame(rows, "labels map<string,string>")
    rules = [
        relabel.Rule(("a", "b"), "(.*);(.*)", "ab", "$2/$1"),
        relabel.Rule(("ab",), "1/(.+)", "first", "<$1>"),
        relabel.Rule(("nothing",), target="gone"),
        relabel.Rule(target="fixed", replacement="f"),
        relabel.Rule(("a",), "x", action="keep"),
    ]
    assert [r.labels for r in relabel.relabel(df, rules).collect()] == [
        {"a": "x", "b": "1", "ab": "1/x", "first": "<x>", "fixed": "f"}]
    kept = relabel.relabel(df, rules, ["ab", "gone", "first"]).first()
    assert tuple(kept) == ("1/x", None, "<x>")
    with pytest.raises(ValueError):
        relabel.relabel(df, [relabel.Rule(action="hash")])


# -- sinks ---------------------------------------------------------------------------------------


def test_samples_are_laid_out_by_metric_and_date(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = [("up", {"i": "1"}, at(0), 1.0), ("up", {"i": "1"}, at(86400), 0.0), ("keys", {"i": "1"}, at(0), 5.0)]
    writers.write_samples(spark.createDataFrame(rows, schemas.METRIC_SAMPLE), path)
    back = readers.read_samples(spark, path)
    assert back.count() == 3
    plan = back.where("metric = 'up' and date = DATE'2024-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert rates.retain(back, "2h").count() == 1 and rates.retain(back, "2d").count() == 3
    assert "PartitionFilters: [isnotnull(metric" in plan and rows_of(rates.promote(back, "keys", ["i"]), "i", "value") == [("1", 5.0)]


def polled(spark, rows):
    """(minute, ord, coordinator, version, cluster, kind, ok, items) as a view."""
    start = datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(start + timedelta(minutes=m), o, n, v, c, k, ok, kv) for m, o, n, v, c, k, ok, kv in rows], schemas.COORDINATOR_VIEW)


def led(minute, ord, name, cluster, port, ok=True, version=6):
    return minute, ord, name, version, cluster, "master", ok, ["name", cluster, "ip", "h", "port", str(port)] if ok else None


FLEET = [
    # Removed after the second minute, in its place another; stale: not asked for ten minutes.
    led(0, 0, "s-1", "c", 1), led(1, 0, "s-1", "c", 1), led(2, 0, "s-9", "c", 9), led(10, 2, "s-3", "c", 3),
    # Moved from place 3 to place 1.
    led(5, 3, "s-2", "c", 7), led(19, 1, "s-2", "c", 2), led(20, 1, "s-2", "c", 2),
    # There, but its last reply on c is bad.
    led(12, 4, "s-4", "c", 4), led(20, 4, "s-4", "c", 4, ok=False), led(20, 4, "s-4", "d", 44), led(20, 5, "s-5", "d", 55, version=8),
]


def test_coordinators_there_are_now(spark):
    view = polled(spark, FLEET)
    assert rows_of(topo.coordinators(view), "ord", "coordinator", "port") == [(1, "s-2", 2), (4, "s-4", 4), (5, "s-5", 5)]
    then = datetime(2024, 1, 1, 0, 2)
    assert rows_of(topo.coordinators(view, then), "ord", "coordinator") == [(0, "s-9")]
    whole = rows_of(topo.coordinators(view, look_back=None), "ord", "coordinator")
    assert whole == [(0, "s-9"), (1, "s-2"), (2, "s-3"), (4, "s-4"), (5, "s-5")]
    seen = {(r.ord, r.coordinator): (r.from_ts.minute, r.to_ts.minute) for r in topo.validity(view).collect()}
    assert seen[0, "s-1"] == (0, 1) and seen[3, "s-2"] == (5, 5) and seen[1, "s-2"] == (19, 20)


def test_only_coordinators_of_now_tell_leaders(spark):
    view = polled(spark, FLEET)
    assert rows_of(topo.current_leader(view), "cluster", "leader_port", "told_by") == [("c", 2, 1), ("d", 44, 4)]
    assert rows_of(topo.masters(view), "ord", "name", "address") == [(1, "c", "h:2"), (4, "d", "h:44"), (5, "d", "h:55")]
    assert rows_of(topo.discovered_masters(view), "name", "address") == [("c", "h:2")]
    nodes = spark.createDataFrame([("n9", "c", 9, "replica"), ("n2", "c", 2, "replica"), ("n44", "d", 44, "master")], "name string, cluster string, port bigint, role_label string")
    assert rows_of(reports.removal_check(nodes, view), "name", "may_go") == [("n2", False), ("n44", False), ("n9", True)]
    states = spark.createDataFrame([("c", "V6Destroyed"), ("d", "V6Destroyed"), ("e", "V6Destroyed")], "cluster string, state string")
    plan = reports.registration_plan(states, view, topo.coordinators(view))
    assert rows_of(plan, "cluster", "leader_port", "quorum") == [("c", 2, 2), ("d", 44, 2), ("e", None, 2)]


def test_followers_of_the_first_good_refresh(spark):
    def lists(minute, ord, name, port, ok=True):
        return minute, ord, name, 6, "c", "replicas", ok, ["ip", "h", "port", str(port)] if ok else None

    view = polled(spark, [lists(0, 0, "old", 1), lists(19, 0, "s-1", 2), lists(20, 0, "s-1", 0, ok=False), lists(18, 1, "s-2", 8), lists(20, 1, "s-2", 3), lists(20, 2, "s-3", 4)])
    assert rows_of(topo.listed_now(view), "ord", "port") == [(1, 3)]


def test_last_replies_are_found_before_they_are_read(spark, tmp_path):
    path = str(tmp_path / "view")
    polled(spark, FLEET).write.parquet(path)
    view = readers.read_coordinator_view(spark, path)
    plan = topo.last_replies(view, "master")._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "GreaterThanOrEqual(poll_ts" in plan
    narrow = topo.coordinators(view)._jdf.queryExecution().executedPlan().toString()
    assert "kv" not in narrow
