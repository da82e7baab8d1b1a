"""Streams over several files and restarts give what one batch over everything gives."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetpulse.operators import convergence, lifecycle, probes, rates
from fleetpulse.operators import topology as topo
from fleetpulse.sources import driver_tables, readers, schemas, writers
from fleetpulse.streaming import live, running, tail
from conftest import FOLDER

PARTS = 4


def rows_of(df):
    cols = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.fixture
def files(spark, tmp_path):
    """Write a table as several files in time order; returns a function that adds the next ones."""

    def make(df, order):
        # Rows of one instant stay in one file if `order` is the time alone.
        path = str(tmp_path / "in")
        place = F.percent_rank().over(Window.orderBy(*order))
        numbered = df.withColumn("part", F.least(F.lit(PARTS), 1 + F.floor(place * PARTS)))
        numbered.persist()

        def add(part):
            numbered.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(path)

        return path, add

    return make


def drain(started):
    started.awaitTermination()


def one_file(spark, read, path):
    return read(spark, path, stream=True, maxFilesPerTrigger=1)


def test_lag(spark, files, tmp_path):
    log = driver_tables.probe_log(spark, FOLDER)
    path, add = files(log, probes.ORDER)
    out = str(tmp_path / "out")
    for part in range(1, PARTS + 1):
        # A restart after each file: the state comes from the folder.
        add(part)
        drain(running.run_steps(one_file(spark, readers.read_probe_log, path), live.lag_step, out, live.LAG_STATE))
    assert rows_of(running.results(spark, out).drop("batch")) == rows_of(probes.replica_lag(log))
    assert running.results(spark, out).select("batch").distinct().count() == PARTS


def test_a_batch_run_again_counts_once(spark, tmp_path):
    log = driver_tables.probe_log(spark, FOLDER)
    first, second = log.where("seq < 500"), log.where("seq >= 500")
    empty = spark.createDataFrame([], live.LAG_STATE)
    _, state = live.lag_step(first, empty)
    rows, once = live.lag_step(second, state)
    again, twice = live.lag_step(second, state)
    assert rows_of(rows) == rows_of(again) and rows_of(once) == rows_of(twice)
    assert rows_of(once.select("cluster", "n")) == rows_of(
        probes.value_gauges(log).where("role = 'master_read'").select("cluster", "n"))


def test_lifecycle(spark, files, tmp_path):
    log = driver_tables.trigger_log(spark, FOLDER)
    path, add = files(log, ["ts", "seq"])
    out = str(tmp_path / "out")
    for part in range(1, PARTS + 1):
        add(part)
    drain(running.run_steps(one_file(spark, readers.read_triggers, path), live.lifecycle_step, out, live.LIFECYCLE_STATE))
    assert rows_of(running.current(spark, out)) == rows_of(lifecycle.replay(log))


def test_follower_sets(spark, files, tmp_path):
    view = driver_tables.follower_polls(spark, FOLDER)
    path, add = files(view, ["poll_ts"])
    out = str(tmp_path / "out")
    for part in range(1, PARTS + 1):
        add(part)
    polls = topo.followers(one_file(spark, readers.read_coordinator_view, path))
    drain(running.run_steps(polls, live.follower_step, out, live.FOLLOWER_STATE))
    whole = topo.followers(view)
    assert rows_of(live.changes_now(spark, out)) == rows_of(probes.follower_changes(whole))
    seen = probes.refreshes(whole)
    last = seen.groupBy("cluster").agg(F.max("poll_ts").alias("poll_ts"))
    assert rows_of(live.sets_now(spark, out)) == rows_of(seen.join(last, ["cluster", "poll_ts"], "left_semi"))


REPLIES = "cluster string, poll_ts timestamp_ntz, ord int, addr string, ok boolean"


def at(minute, second=0):
    return datetime(2024, 1, 1, 0, minute, second)


def test_a_refresh_over_two_batches(spark):
    first = spark.createDataFrame([("c", at(0), 0, "a", True), ("c", at(0), 0, "b", True), ("c", at(1), 0, "a", True)], REPLIES)
    second = spark.createDataFrame([("c", at(1), 0, "b", True), ("c", at(1), 1, "z", True), ("c", at(2), 0, "a", True)], REPLIES)
    third = spark.createDataFrame([("c", at(3), 0, None, False), ("c", at(0), 0, "late", True)], REPLIES)
    state, rows = spark.createDataFrame([], live.FOLLOWER_STATE), []
    for batch in (first, second, third):
        changes, state = live.follower_step(batch, state)
        rows.append(rows_of(changes.select("addr", "change", "ts", "cluster")))
    assert rows == [[("a", "joined", "c", at(0)), ("b", "joined", "c", at(0))], [], [("b", "left", "c", at(2))]]
    assert rows_of(state.where("closed").select("addr", "poll_ts")) == [("a", at(2))]


def tail_batch(spark, commands=(), replies=()):
    given = spark.createDataFrame([(t, i, n, c, "x") for t, i, n, c in commands], schemas.COMMAND_LOG)
    view = [(t, o, f"s{o}", 6, c, "master", True, ["name", c, "ip", "h", "port", p]) for t, o, c, p in replies]
    return tail.both(given, spark.createDataFrame(view, schemas.COORDINATOR_VIEW))


def inventory(session):
    return session.createDataFrame([("n1", "c", 1), ("n2", "c", 2), ("m1", "d", 1)], "name string, cluster string, port bigint")


def test_commands_wait_for_leadership(spark):
    step = tail.follow_leader(inventory)
    state = spark.createDataFrame([], tail.TAIL_STATE)

    def run(commands=(), replies=()):
        nonlocal state
        rows, after = step(tail_batch(spark, commands, replies), state)
        found = sorted((r.seq, r.late) for r in rows.collect())
        state = spark.createDataFrame(after.collect(), tail.TAIL_STATE)
        return found, sorted(r.seq for r in state.where("kind = 'wait'").collect())

    assert run([(at(1), 1, "n1", "c"), (at(2), 2, "n2", "c"), (None, 3, "n1", "c")], [(at(0), 0, "c", "1"), (at(1), 1, "c", "2"), (at(1), 0, "d", "1")]) == ([], [1, 2])
    # The first coordinator of the poll at 1 comes a batch later and has the last word.
    assert run([], [(at(1), 0, "c", "1"), (at(2), 0, "c", "x")]) == ([(1, False)], [2])
    assert run([(at(1, 59), 4, "n1", "c")], [(at(1, 30), 0, "c", "2")]) == ([(4, False)], [2])  # too late a reply
    # 2 is known to be led by n1 at 2, and n2 leads from 3 on.
    assert run([(at(3), 5, "n2", "c"), (at(3), 6, "n1", "c")], [(at(3), 0, "c", "2"), (at(4), 0, "c", "2")]) == ([(5, False)], [])
    # d is not polled again, but c is known a minute further.
    assert run([(at(4), 7, "m1", "d")], [(at(6), 0, "c", "2")]) == ([(7, False)], [])


def test_late_commands_are_marked(spark, tmp_path):
    step = tail.follow_leader(inventory, keep="5m")
    _, state = step(tail_batch(spark, [], [(at(m), 0, "c", str(1 + m // 10 % 2)) for m in range(41)]), spark.createDataFrame([], tail.TAIL_STATE))
    state = spark.createDataFrame(state.collect(), tail.TAIL_STATE)
    rows, _ = step(tail_batch(spark, [(at(1), 1, "n1", "c"), (at(39), 2, "n2", "c"), (at(31), 3, "n1", "c")]), state)
    assert sorted((r.seq, r.late) for r in rows.collect()) == [(1, True), (2, False)]
    assert state.where("kind = 'run'").count() == 1 and state.where("kind = 'cut'").first().ts == at(30)


def test_tail_state_stays_small(spark, tmp_path):
    """Twelve batches with a new leader every poll: the state holds what `keep` asks for, not the past."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = tail.both(spark.createDataFrame([], schemas.COMMAND_LOG), spark.createDataFrame([], schemas.COORDINATOR_VIEW)).schema
    sizes, commands, replies = [], [], []
    for i in range(12):
        now = datetime(2024, 1, 1) + timedelta(minutes=i)
        mine = [(now + timedelta(seconds=s), i * 60 + s, f"n{1 + s % 2}", "c") for s in range(0, 60, 7)]
        told = [(now + timedelta(seconds=s), 0, "c", str(1 + s // 20 % 2)) for s in range(0, 60, 20)]
        commands, replies = commands + mine, replies + told
        tail_batch(spark, mine, told).coalesce(1).write.mode("append").parquet(path)
        drain(running.run_steps(spark.readStream.schema(schema).parquet(path), tail.follow_leader(inventory, keep="3m"), out, tail.TAIL_STATE))
        sizes.append(running.current(spark, out).count())
    assert max(sizes[6:]) <= max(sizes[:6]) <= 30
    whole = tail_batch(spark, commands, replies)
    view = whole.where("what = 'reply'")
    intervals = convergence.leader_intervals(convergence.leader_changes(view), inventory(spark))
    want = convergence.leader_commands(whole.where("what = 'command'").select(*tail.COMMAND), intervals)
    assert rows_of(tail.commands_now(spark, out, intervals)) == rows_of(want) and want.count()


def test_retention_deletes_hours(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    samples = []
    for hour in (0, 1, 2, 9):
        samples.append(("m", {"a": "b"}, datetime(2024, 1, 1, hour, 30), float(hour)))
        spark.createDataFrame([samples[-1], ("m", {}, None, 0.0)], schemas.METRIC_SAMPLE).coalesce(1).write.mode("append").parquet(path)
        drain(live.run_retained(spark.readStream.schema(schemas.METRIC_SAMPLE).parquet(path), out, "8h"))
        everything = spark.createDataFrame(samples, schemas.METRIC_SAMPLE)
        assert [r.value for r in live.retained(spark, out, "8h").orderBy("ts").collect()] == [
            r.value for r in rates.retain(everything, "8h").orderBy("ts").collect()]
    assert sorted(running.folders(spark, f"{out}/kept/date=2024-01-01")) == ["hour=1", "hour=2", "hour=9"]


def test_batches_leave_no_scratch(spark, files, tmp_path):
    log = driver_tables.probe_log(spark, FOLDER)
    path, add = files(log, probes.ORDER)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("fleetpulse.localScratch")
    before = set(running.folders(spark, f"{root}/fleetpulse"))
    for part in (1, 2):
        add(part)
        drain(running.run_steps(one_file(spark, readers.read_probe_log, path), live.lag_step, str(tmp_path / "out"), live.LAG_STATE))
    assert set(running.folders(spark, f"{root}/fleetpulse")) == before


def test_running_tables(spark, files, tmp_path):
    log = driver_tables.probe_log(spark, FOLDER)
    path, add = files(log, probes.ORDER)
    for part in range(1, PARTS + 1):
        add(part)
    for i, op in enumerate((probes.op_counts, probes.error_counts, probes.latency_histogram)):
        out = str(tmp_path / f"out{i}")
        drain(running.run_table(op(one_file(spark, readers.read_probe_log, path)), out))
        now, want = running.current(spark, out), op(log)
        if "sum" in want.columns:  # batches add doubles in another order
            now, want = (df.withColumn("sum", F.round("sum", 9)) for df in (now, want))
        assert rows_of(now) == rows_of(want)


def test_rate_over_several_batches(spark, files, tmp_path):
    log = driver_tables.probe_log(spark, FOLDER)
    path, add = files(log, probes.ORDER)
    out = str(tmp_path / "out")
    # The last part comes first, so most rows are days late.
    for part in (PARTS, *range(1, PARTS)):
        add(part)
        drain(live.run_rate(one_file(spark, readers.read_probe_log, path), ["cluster", "role"], out, "1h", span="1d", lateness="1d"))
    whole = rates.op_rate(log, ["cluster", "role"], "6h", "1h")
    assert rows_of(live.rate_now(spark, out, "6h", "1h")) == rows_of(whole) and whole.count()
    some = live.rate_now(spark, out, "6h", "1h", since="2024-01-20T00:00:00", span="1d")
    assert rows_of(some) == rows_of(whole.where("ts >= timestamp_ntz'2024-01-20 00:00:00'")) and some.count()


def test_rate_writes_what_a_batch_touches(spark, tmp_path):
    """Twenty batches of five minutes, in each one row that is hours late: what a batch writes and what is
    open stays the same however long the stream has run, and no count is lost or taken twice."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ts timestamp_ntz, cluster string"
    every, wrote, opened = [], [], []
    for i in range(20):
        now = datetime(2024, 1, 1) + timedelta(minutes=5 * i)
        rows = [(now + timedelta(seconds=s), f"c{s % 3}") for s in range(0, 300, 20)] + [(now - timedelta(hours=i % 7), "c0"), (None, "c1")]
        every += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        drain(live.run_rate(stream, ["cluster"], out, "15s", "30m", "10m"))
        files = [str(f) for f in (tmp_path / "out").rglob("*.parquet")]
        wrote.append(sum(f"batch={i}/" in f or f"upto={i}/" in f for f in files))
        opened.append(len(running.folders(spark, f"{out}/open")))
        if i == 19:
            whole = rates.op_rate(spark.createDataFrame(every, schema).where("ts IS NOT NULL"), ["cluster"], "1m", "15s")
            assert rows_of(live.rate_now(spark, out)) == rows_of(whole)
    assert max(wrote[10:]) <= max(wrote[:10]) <= 6 and max(opened) <= 6
    # A sum stands for its range alone, and a range is one file again once it is closed.
    assert all(len(running.folders(spark, f"{out}/closed/{s}")) <= 2 for s in running.folders(spark, f"{out}/closed") if "=" in s)


def test_rate_batch_run_again(spark, tmp_path):
    """The same batch once more, after its folders were written and summed but before it was committed."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ts timestamp_ntz, cluster string"
    every = []
    for i in range(4):
        rows = [(datetime(2024, 1, 1, 2 * i), "a"), (datetime(2024, 1, 1, 0, 1), "b")]
        every += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        for again in range(2):
            drain(live.run_rate(spark.readStream.schema(schema).parquet(path), ["cluster"], out, "15s", "30m", "10m"))
            if not again:
                (tmp_path / "out" / "checkpoint" / "commits" / str(i)).unlink()
                for crc in (tmp_path / "out" / "checkpoint" / "commits").glob(f".{i}.*"):
                    crc.unlink()
        whole = rates.op_rate(spark.createDataFrame(every, schema), ["cluster"], "1m", "15s")
        assert rows_of(live.rate_now(spark, out)) == rows_of(whole)


def test_command_tail(spark, tmp_path):
    commands = driver_tables.command_log(spark, FOLDER)
    path = str(tmp_path / "in")
    commands.write.parquet(path)
    query = writers.tail_commands(readers.read_commands(spark, path, stream=True), "memory", queryName="tail")
    query.processAllAvailable()
    query.stop()
    assert spark.table("tail").count() == commands.count()


def test_cadence(spark):
    class Writer:
        def trigger(self, **kwargs):
            return kwargs

    assert running.every(Writer(), "scrape") == {"processingTime": "15 seconds"}
    assert running.every(Writer(), None) == {"availableNow": True}


def test_schemas_match_the_tables(spark):
    for schema, make in ((schemas.PROBE_LOG, driver_tables.probe_log), (schemas.COORDINATOR_VIEW, driver_tables.coordinator_view),
                         (schemas.TRIGGER_LOG, driver_tables.trigger_log), (schemas.METRIC_SAMPLE, driver_tables.probe_samples),
                         (schemas.COMMAND_LOG, driver_tables.command_log), (schemas.NODE_SNAPSHOT, driver_tables.node_snapshot),
                         (schemas.NODE_LABELS, driver_tables.node_labels), (schemas.DISCOVERED_TARGET, driver_tables.discovered_target)):
        want = [x.strip().split(" ") for x in schema.replace("map<string,string>", "map").replace("array<string>", "array").split(",")]
        got = [(n, t.split("<")[0]) for n, t in make(spark, FOLDER).dtypes]
        assert got == [tuple(x) for x in want]
