"""Sinks: samples, state snapshots and command lines."""

import contextlib
import os
import uuid
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.operators.sizing import at_path
from fleetpulse.streaming.running import every

# The name Spark's writer gives where there is none, and how many documents are moved at a time.
NO_NAME = "__HIVE_DEFAULT_PARTITION__"
MOVES = 32


def write_samples(samples: DataFrame, path: str, mode: str = "append") -> None:
    """Write samples by metric and date.

    The rebalancing makes files of about one size: folders with few rows get one file, and a
    metric that holds most of the rows is split over many tasks.
    """
    dated = samples.withColumn("date", F.col("ts").cast("date"))
    dated.hint("rebalance", "metric", "date").write.mode(mode).partitionBy("metric", "date").parquet(path)


def write_states(states: DataFrame, path: str) -> None:
    """Write a state table as a new snapshot; a table never replaces the one it was read from."""
    states.select("cluster", "state").write.mode("errorifexists").parquet(path)


def write_state_files(states: DataFrame, folder: str) -> None:
    """Write a state table as one JSON document per cluster, ``<folder>/<cluster>.json``.

    All documents are written before the first gets its name. In a folder of plain files tasks write them as
    such: for each of them Spark's writer would make a folder, a file and its checksum, and start a process for
    the mode of each of these. In any other store Spark writes them, each in a folder of its own."""
    spark = states.sparkSession
    folder = folder.rstrip("/")
    files, place = at_path(spark, f"{folder}/_made")
    # The work goes with the number of documents, so tasks are not put together by their few bytes.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = states.select("cluster", "state")
    if files.getUri().getScheme() == "file":
        files.mkdirs(place)
        _plain_documents(rows, tasks, files.makeQualified(place.getParent()).toUri().getPath())
    else:
        _stored_documents(rows, tasks, folder)
    files.delete(place, True)


def _plain_documents(states: DataFrame, tasks: int, folder: str) -> None:
    """Each run of a task writes into a folder of its own, so that it may run twice; what those hold that came
    to an end is moved, which takes some microseconds a document."""

    def write(rows):
        own = f"{folder}/_made/{uuid.uuid4().hex}"
        os.makedirs(own)
        for name, of_name in groupby(rows, lambda row: row[0]):
            path = f"{own}/{name}.json"
            if ":" in os.path.basename(path):
                raise ValueError(f"no reader of Hadoop can open {name}.json")
            if "/" in name:
                os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w", encoding="utf-8", newline="") as file:
                file.writelines(f"{row[1]}\n" for row in of_name)
        yield own

    name = F.coalesce(F.nullif("cluster", F.lit("")), F.lit(NO_NAME)).alias("name")
    documents = states.select(name, F.to_json(F.struct("state"))).repartition(tasks, "name").sortWithinPartitions("name")
    for own in documents.rdd.mapPartitions(write).collect():
        for at, _, names in os.walk(own):
            to = folder + at.removeprefix(own)
            os.makedirs(to, exist_ok=True)
            for name in names:
                with contextlib.suppress(FileNotFoundError):
                    os.remove(f"{to}/.{name}.crc")  # of a document that had this name and a checksum
                os.replace(f"{at}/{name}", f"{to}/{name}")


def _stored_documents(states: DataFrame, tasks: int, folder: str) -> None:
    """The documents by Spark's writer; the driver moves many of them at a time."""
    spark = states.sparkSession
    states.repartition(tasks, "cluster").write.partitionBy("cluster").json(f"{folder}/_made")
    files, every_part = at_path(spark, f"{folder}/_made/cluster=*/part-*")

    def move(found) -> None:
        part = found.getPath()
        cluster = unquote(part.getParent().getName().removeprefix("cluster="))
        files.rename(part, at_path(spark, f"{folder}/{cluster}.json")[1])

    with ThreadPoolExecutor(MOVES) as pool:
        list(pool.map(move, files.globStatus(every_part)))


def write_command_lines(commands: DataFrame, path: str) -> None:
    """Write commands as plain lines under ``cluster=<cluster>/node=<node>/``, as `read_command_lines` reads them."""
    commands.select("cluster", "node", "line").hint("rebalance", "cluster", "node").write.partitionBy("cluster", "node").text(path)


def tail_commands(commands: DataFrame, sink: str = "console", cadence: str | None = None, **options):
    """Start printing a stream of commands line by line; returns the running query. With a Parquet `sink` the
    lines are kept under the option `path`. Without a cadence it takes all there is and stops."""
    writer = commands.select("line").writeStream.format(sink)
    if sink == "console":
        writer = writer.option("truncate", False)
    return every(writer.options(**options), cadence).start()
