"""Edge rows of the scalar functions, with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from fleetpulse import functions as fn
from fleetpulse.functions.numbers import micros, seconds

NS = 1704067200000000000


def one(spark, make, value, schema):
    return spark.createDataFrame([(value,)], f"x {schema}").select(make(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "raw, expected",
    [
        (f"12:{NS}", (12, NS)), ("+5:7", (5, 7)), ("-5:7", (-5, 7)), ("garbage", None), ("", None), ("12", None),
        (":5", None), ("5:", None), ("1:2:3", None), (" 5:6", None), ("5:6 ", None), ("1_0:2", None), ("5.0:6", None),
        ("1:2\n", None), ("99999999999999999999:1", None), (None, None),
    ],
)
def test_parse_value(spark, raw, expected):
    got = one(spark, fn.parse_value, raw, "string")
    assert (tuple(got) if got else None) == expected


def test_format_value(spark):
    df = spark.range(1).select(fn.format_value(F.lit(3), F.lit(NS)).alias("y"))
    assert df.first().y == f"3:{NS}"


@pytest.mark.parametrize(
    "err, timeout, kind",
    [
        (None, False, None), ("redis: nil", False, None), ("READONLY You can't write", False, "readonly"),
        ("READONLY You can't write", True, "timeout"), ("was READONLY", False, "other"), ("LOADING x", False, "loading"),
        ("MASTERDOWN x", False, "master_down"), ("context deadline exceeded", False, "timeout"),
        ("dial tcp: i/o timeout", False, "timeout"), ("EOF", False, "network"), ("eof", False, "other"),
        ("read: connection reset by peer", False, "network"), ("write: broken pipe", False, "network"),
        ("dial: connection refused", None, "network"), (None, True, None),
    ],
)
def test_error_kind(spark, err, timeout, kind):
    df = spark.createDataFrame([(err, timeout)], "err string, t boolean")
    row = df.select(fn.error_kind(F.col("err"), F.col("t")).alias("k"), fn.op_status(F.col("err"), F.col("t")).alias("s")).first()
    assert (row.k, row.s) == (kind, "ok" if kind is None else "error")


@pytest.mark.parametrize(
    "reply, expected",
    [
        (["port", "1", "port", "2"], "2"), (["port", "1", "port"], "1"), (["name", "port", "x", "y"], None),
        (["name", "port", "port", "3"], "3"), (["port", "7", "name", "port"], "7"), (["", "x", "port", "4"], "4"),
        (["port", None], ""), (["port"], None), ([], None), (None, None), ([None, "a", "port", "5"], "5"),
    ],
)
def test_kv_get(spark, reply, expected):
    assert one(spark, lambda c: fn.kv_get(c, "port"), reply, "array<string>") == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("# Replication\r\nrole:slave\r\nmaster_host:fe80::1\r\nmaster_port:6384\r\nmaster_link_status:up\r\n",
         ("slave", "fe80::1", 6384, "up")),
        ("role:slave\nrole:master\n", ("master", "", 0, "")),
        ("role:slave\nmaster_port:x\n", ("slave", "", 0, "")),
        ("  \trole:slave \x0b\nslave0:role:x\nmaster_port:-1", ("slave", "", -1, "")),
        ("", ("", "", 0, "")), (None, None),
    ],
)
def test_replication_state(spark, text, expected):
    got = one(spark, fn.replication_state, text, "string")
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize(
    "report, port, leader, role, follows, target, synced, chained",
    [
        (None, 1, 2, "unreachable", None, None, False, False),
        (("master", "", 0, ""), 1, 2, "isolated", "-", 0, False, False),
        (("master", "", 0, ""), 2, 2, "master", "-", 0, False, False),
        (("master", "", 0, ""), 1, 0, "master", "-", 0, False, False),
        (("master", "", 0, ""), 1, None, "master", "-", 0, False, False),
        (("slave", "h", 2, "up"), 1, 2, "replica", "h:2 (up)", 2, True, False),
        (("slave", "h", 22, "up"), 1, 2, "replica", "h:22 (up)", 22, False, True),
        (("slave", "h", 2, "down"), 1, 2, "replica", "h:2 (down)", 2, False, False),
        (("sync", "", 0, ""), 1, 2, "sync", "-", 0, False, False),
    ],
)
def test_roles(spark, report, port, leader, role, follows, target, synced, chained):
    df = spark.createDataFrame(
        [(report, port, leader)],
        "r struct<role:string,master_host:string,master_port:bigint,link:string>, port bigint, leader bigint",
    )
    r, leader_port = F.col("r"), F.col("leader")
    row = df.select(
        fn.live_role(r, F.col("port"), leader_port).alias("role"), fn.replicating_from(r).alias("follows"),
        fn.replication_target(r).alias("target"), fn.is_synced(r, leader_port).alias("synced"),
        fn.is_chained(r, leader_port).alias("chained"),
    ).first()
    if report is None:
        follows = "-"
    assert tuple(row) == (role, follows, target, synced, chained)


@pytest.mark.parametrize(
    "text, expected",
    [("6380-6500", (6380, 6500)), ("6380", None), ("5-5", None), ("6-5", None), ("a-5", None), (" 1-5", None),
     ("1-2-3", None), ("1--2", None), ("-1-5", None)],
)
def test_port_range(spark, text, expected):
    got = one(spark, fn.parse_port_range, text, "string")
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize(
    "text, expected",
    [("200ms", 0.2), ("10s", 10.0), ("1m", 60.0), ("2h", 7200.0), ("1d", 86400.0), ("1h30m", 5400.0), ("1.5s", 1.5),
     ("10", None), ("s", None), ("1x", None), ("", None), (None, None)],
)
def test_duration(spark, text, expected):
    assert one(spark, fn.parse_duration, text, "string") == expected
    if expected is not None:
        assert seconds(text) == expected and micros(text) == round(expected * 1e6)
    elif text is not None:
        with pytest.raises(ValueError):
            seconds(text)


def test_names(spark):
    row = spark.range(1).select(
        fn.instance_name(F.lit("mc"), F.lit(6380)), fn.coordinator_name(F.lit(26379)), fn.probe_name(F.lit("mc")),
        fn.addr(F.lit("h"), F.lit(1)), fn.target_uri(F.lit("n"), F.lit(6380)), fn.label_key(F.lit("x.target.port")),
    ).first()
    assert tuple(row) == (
        "fleet-mc-6380", "fleet-sentinel-26379", "fleet-workload-mc", "h:1", "redis://n:6380",
        "__meta_docker_container_label_x_target_port",
    )


def test_lifecycle_columns(spark):
    row = spark.range(1).select(
        fn.version_group(F.lit(6)), fn.version_group(F.lit(0)), fn.initial_state(F.lit(6)), fn.initial_state(F.lit(8)),
        fn.priority_for(F.lit(6)), fn.priority_for(F.lit(7)), fn.step_mark(F.lit(0), F.lit(1)),
        fn.step_mark(F.lit(1), F.lit(1)), fn.step_mark(F.lit(2), F.lit(1)),
        fn.command_for(F.lit("Failover"), F.lit("mc")), fn.command_for(F.lit("?"), F.lit("mc")),
    ).first()
    assert tuple(row) == (
        "v6", "v8", "AllV6", "Done", 100, 1, "done", "current", "pending", "fleet sentinel failover mc", None,
    )
