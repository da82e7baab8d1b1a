"""Readers give back what was written, in the order of their schema, as batch and as stream."""

import pytest

from fleetpulse.operators import relabel
from fleetpulse.operators import topology as topo
from fleetpulse.sources import driver_tables, readers, writers
from conftest import FOLDER

TABLES = [
    (readers.read_probe_log, driver_tables.probe_log), (readers.read_commands, driver_tables.command_log),
    (readers.read_coordinator_view, driver_tables.coordinator_view), (readers.read_triggers, driver_tables.trigger_log),
    (readers.read_containers, driver_tables.node_labels), (readers.read_nodes, driver_tables.node_snapshot),
]


@pytest.mark.parametrize("read, make", TABLES)
def test_round_trip(spark, tmp_path, read, make):
    path = str(tmp_path / "t")
    rows = make(spark, FOLDER)
    rows.write.parquet(path)
    back = read(spark, path)
    assert back.columns == rows.columns and back.count() == rows.count()
    plain = [c for c, t in rows.dtypes if not t.startswith("map")]
    assert back.select(*plain).exceptAll(rows.select(*plain)).isEmpty()


@pytest.mark.parametrize("read", [readers.read_probe_log, readers.read_commands, readers.read_triggers, readers.read_coordinator_view])
def test_streams_have_the_same_columns(spark, tmp_path, read):
    path = tmp_path / "t"
    path.mkdir()
    stream = read(spark, str(path), stream=True)
    assert stream.isStreaming and stream.columns == read(spark, str(path)).columns


def test_targets_under_management(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = driver_tables.discovered_target(spark, FOLDER)
    rows.write.parquet(path)
    managed = topo.label_filter(driver_tables.node_labels(spark, FOLDER), {}).count()
    targets = readers.read_targets(spark, path)
    assert targets.count() == 2 * managed
    assert relabel.scrape_targets(targets).where("job = 'redis-instances'").count() == topo.data_plane(
        topo.nodes(driver_tables.node_labels(spark, FOLDER))).count()


def test_state_files(spark, tmp_path):
    folder = str(tmp_path / "states")
    states = spark.createDataFrame([("c1", "AllV6"), ("c 2=x", "Done")], "cluster string, state string")
    writers.write_state_files(states, folder)
    assert sorted(f.name for f in (tmp_path / "states").glob("*.json")) == ["c 2=x.json", "c1.json"]
    assert sorted(map(tuple, readers.read_states(spark, folder).collect())) == [("c 2=x", "Done"), ("c1", "AllV6")]
    (tmp_path / "states" / "broken.json").write_text("{\n \"state\": ")
    with pytest.raises(Exception, match="broken.json|FAILFAST|Malformed"):
        readers.read_states(spark, folder).collect()


ODD = [("c1", "AllV6"), ("c 2=x", "Done"), ("a.b", 'q"\u00fc\n'), ("%41+", None), ("\u00fc#?", "Done"), ("s/t", "Done"),
       ("twice", "Done"), ("twice", "Done"), (None, "AllV6"), ("_hidden", "Done")]


def test_state_files_in_any_store(spark, tmp_path):
    """Tasks write plain files: no checksum, no folder and so no process for each. They have the names and the bytes
    that Spark's writer gives in other stores, here one that Spark alone can open."""
    states = spark.createDataFrame(ODD, "cluster string, state string")
    (tmp_path / "store").mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.states.link./store", f"file://{tmp_path}/store")
    writers.write_state_files(states, f"file://{tmp_path}/plain/")
    writers.write_state_files(states, "viewfs://states/store/in")
    found = [{str(f.relative_to(at)): f.read_bytes() for f in at.rglob("*") if f.is_file()} for at in (tmp_path / "plain", tmp_path / "store/in")]
    assert found[0] == {name: text for name, text in found[1].items() if not name.endswith(".crc")}
    assert len(found[0]) == 9 and found[0]["twice.json"] == b'{"state":"Done"}\n' * 2 and found[0]["%41+.json"] == b"{}\n"
    back = [sorted(map(tuple, readers.read_states(spark, at).collect()), key=str) for at in (str(tmp_path / "plain"), "viewfs://states/store/in")]
    assert back[0] == back[1] == sorted(((*row,) for row in set(ODD) if row[0] not in ("s/t", None, "_hidden")), key=str)


def test_state_files_again(spark, tmp_path):
    """A table may replace the documents it was read from; what an ended run left, and checksums, do not count."""
    folder = tmp_path / "states"
    writers.write_state_files(spark.createDataFrame([("c1", "AllV6"), ("c2", "Done")], "cluster string, state string"), str(folder))
    (folder / ".c1.json.crc").write_bytes(b"crc\0\0\0\2\0\0\0\0\0")
    (folder / "_made/run").mkdir(parents=True)
    (folder / "_made/run/c3.json").write_text("{")
    states = readers.read_states(spark, str(folder)).where("cluster = 'c2'").union(spark.createDataFrame([("c1", "Done")], "cluster string, state string"))
    writers.write_state_files(states, str(folder))
    assert sorted(map(tuple, readers.read_states(spark, str(folder)).collect())) == [("c1", "Done"), ("c2", "Done")]
    assert sorted(f.name for f in folder.iterdir()) == ["c1.json", "c2.json"]
    with pytest.raises(Exception, match=r"c:[12]\.json"):
        writers.write_state_files(states.selectExpr("replace(cluster, 'c', 'c:') AS cluster", "state"), str(folder))
    assert sorted(map(tuple, readers.read_states(spark, str(folder)).collect())) == [("c1", "Done"), ("c2", "Done")]


def test_many_state_files_are_few_tasks(spark, tmp_path):
    folder = str(tmp_path / "states")
    states = spark.range(2000).selectExpr("concat('c', id) AS cluster", "'Done' AS state")
    writers.write_state_files(states, folder)
    back = readers.read_states(spark, folder)
    assert back.rdd.getNumPartitions() <= max(8, spark.sparkContext.defaultParallelism)
    assert readers.state_clusters(back).count() == 2000 and back.exceptAll(states).isEmpty()
    (tmp_path / "empty").mkdir()
    assert readers.read_states(spark, str(tmp_path / "empty")).isEmpty()


def test_command_lines_as_text(spark, tmp_path):
    path, out = str(tmp_path / "lines"), str(tmp_path / "out")
    commands = spark.createDataFrame([("c", "n1", "a b"), ("c", "n2", ""), ("d", "n1", "x")], "cluster string, node string, line string")
    writers.write_command_lines(commands, path)
    back = readers.read_command_lines(spark, path)
    assert back.columns == ["ts", "seq", "node", "cluster", "line"]
    assert sorted(map(tuple, back.select("cluster", "node", "line").collect())) == [("c", "n1", "a b"), ("c", "n2", ""), ("d", "n1", "x")]
    assert back.where("ts IS NULL").isEmpty()
    query = writers.tail_commands(readers.read_command_lines(spark, path, stream=True), "parquet", path=out, checkpointLocation=f"{out}-c")
    query.awaitTermination()
    assert sorted(r.line for r in spark.read.parquet(out).collect()) == ["", "a b", "x"]
