"""Cases that the fixtures do not hold: several coordinators, overlapping leadership, odd labels."""

from datetime import datetime as T

import pytest
from pyspark.sql import functions as F

from fleetpulse.operators import convergence, probes, relabel, sizing
from fleetpulse.operators import topology as topo
from fleetpulse.plans import waiting


def at(second):
    return T(2026, 1, 1, 0, 0, second)


@pytest.mark.parametrize("few", [500_000, 1])
def test_leader_commands_do_not_depend_on_the_way(spark, limits, few):
    intervals = spark.createDataFrame(
        [("c", "a", at(0), at(10)), ("c", "b", at(5), at(20)), ("c", "a", at(8), at(12)), ("c", "a", at(12), at(14)),
         ("c", "d", at(30), at(30)), ("c", "d", at(40), None), ("c", "d", at(35), at(50)), (None, "a", at(0), None), ("c", None, at(0), None)],
        "cluster string, node string, from_ts timestamp_ntz, to_ts timestamp_ntz")
    rows, want = [], []
    spans = {"a": [(0, 14)], "b": [(5, 20)], "d": [(35, 60)]}
    for i, (node, s) in enumerate((n, s) for n in "abd" for s in range(0, 60)):
        rows.append((i, at(s), "c", node, f"{node}{s}"))
        want += [f"{node}{s}"] if any(a <= s < b for a, b in spans[node]) else []
    rows += [(900, at(1), None, "a", "none"), (901, at(1), "c", None, "none")]
    commands = spark.createDataFrame(rows, "seq bigint, ts timestamp_ntz, cluster string, node string, line string")
    limits(broadcastRows=few)
    assert sorted(r.line for r in convergence.leader_commands(commands, intervals).collect()) == sorted(want)


def test_first_good_coordinator_is_the_refresh(spark):
    rows = [("c", at(1), 0, "a", True), ("c", at(1), 0, "b", True), ("c", at(1), 1, "z", True),
            ("c", at(2), 0, "a", True), ("c", at(2), 1, "a", True), ("c", at(2), 1, "b", True), ("c", at(3), 0, "q", False), ("c", at(3), 1, "a", True)]
    seen = spark.createDataFrame(rows, "cluster string, poll_ts timestamp_ntz, ord int, addr string, ok boolean")
    assert [(r.poll_ts, r.observed) for r in probes.followers_observed(seen).collect()] == [(at(3), 1)]
    assert [(r.addr, r.gone_ts) for r in probes.vanished_followers(seen).collect()] == [("b", at(2))]


def test_priorities_of_one_coordinator_count_together(spark):
    starts = spark.createDataFrame([("c", 1, at(0)), ("none", 2, at(0))], "cluster string, id bigint, ts timestamp_ntz")
    expected = spark.createDataFrame([("c", 1, 10), ("c", 2, 0)], "cluster string, port bigint, priority bigint")
    rows = [("c", at(1), 0, 1, 10, True), ("c", at(1), 1, 2, 0, True), ("c", at(4), 1, 1, 10, True), ("c", at(4), 1, 2, 0, True)]
    shown = spark.createDataFrame(rows, "cluster string, poll_ts timestamp_ntz, ord int, port bigint, priority bigint, ok boolean")
    found = {r.cluster: r.waited_us for r in waiting.time_to_priorities(starts, expected, shown).collect()}
    assert found == {"c": 4_000_000, "none": 0}


def test_priorities_of_the_coordinator_that_is_asked(spark):
    """A second coordinator's answer does not count while the first gives a good one; the last entry of a port does."""
    starts = spark.createDataFrame([("c", 1, at(0)), ("d", 2, at(0))], "cluster string, id bigint, ts timestamp_ntz")
    expected = spark.createDataFrame([("c", 1, 10), ("d", 1, 10)], "cluster string, port bigint, priority bigint")
    rows = [("c", at(1), 0, 1, 7, True, 0), ("c", at(1), 1, 1, 10, True, 0), ("c", at(2), 0, 1, 10, False, 0),
            ("c", at(3), 0, 1, 7, False, 0), ("c", at(3), 1, 1, 10, True, 0), ("d", at(1), 0, 1, 10, True, 0), ("d", at(1), 0, 1, 7, True, 1),
            ("d", at(5), 0, 1, 7, True, 0), ("d", at(5), 0, 1, 10, True, 1)]
    shown = spark.createDataFrame(rows, "cluster string, poll_ts timestamp_ntz, ord int, port bigint, priority bigint, ok boolean, pos int")
    waited = lambda df: {r.cluster: r.waited_us for r in waiting.time_to_priorities(starts, expected, df).collect()}
    assert waited(shown) == {"c": 3_000_000, "d": 5_000_000}
    assert waited(shown.drop("pos")) == {"c": 3_000_000, "d": 1_000_000}


def test_nothing_listed_is_a_problem(spark):
    none = spark.createDataFrame([], "name string, address string")
    assert [(r.name, r.chosen, r.problem) for r in topo.pick_leader(none).collect()] == [(None, False, "no leaders are listed")]


def test_lookup_by_the_name_label(spark):
    rows = [("i", ["/else"], {"fleet.managed": "true", "fleet.name": "n", "fleet.port": "2"}, "up"),
            ("j", ["/n"], {"fleet.managed": "true", "fleet.name": "m", "fleet.port": "1"}, "up"), ("k", ["/n"], {"fleet.name": "n"}, "up")]
    rows = spark.createDataFrame(rows, "id string, names array<string>, labels map<string,string>, status string")
    assert [(r.id, r.name) for r in topo.node_labelled(rows, "n").collect()] == [("i", "else")]


def test_numbers_that_do_not_fit(spark):
    labels = {"fleet.managed": "true", "fleet.version": "99999999999", "fleet.port": "1"}
    rows = spark.createDataFrame([("i", ["/n"], labels, "up")], "id string, names array<string>, labels map<string,string>, status string")
    assert topo.nodes(rows).first().version == 0
    view = spark.createDataFrame([(0, "coordinator", 8), (1, "x-7", 8)], "ord int, coordinator string, version int")
    assert {r.coordinator: r.port for r in topo.coordinators(view).collect()} == {"coordinator": None, "x-7": 7}


def test_long_form_of_groups(spark):
    df = spark.createDataFrame([({"a": "x:1"},)], "labels map<string,string>")
    rules = [relabel.Rule(("a",), "(.+):(.+)", "b", "${2}0-${1}"), relabel.Rule(("a",), target="c", replacement="${1}")]
    assert relabel.relabel(df, rules).first().labels == {"a": "x:1", "b": "10-x", "c": "x:1"}


def test_a_table_of_many_bytes_is_not_broadcast(spark, limits):
    rows = spark.range(20).select((F.col("id") % 3).alias("k"), "id")
    table = spark.range(3).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 10).alias("v"))
    want = sorted(map(tuple, rows.join(table, "k").collect()))
    limits(broadcastBytes=1)
    assert not sizing.few(sizing.written(table, "wide"))
    assert sorted(map(tuple, sizing.lookup_join(rows, table, "k").collect())) == want
    limits(broadcastBytes=1 << 20, broadcastRows=2)
    assert not sizing.few(sizing.written(table, "long"))
    assert sizing.few(sizing.written(table, "known"), 2)
