"""Size checks, and the shared folder for intermediate tables.

Limits can be set in the session (``spark.conf.set``):

* ``fleetpulse.rowsPerTask``: most rows of one key that one task may hold in order;
* ``fleetpulse.foldRows``: the same where the rows become one array in memory;
* ``fleetpulse.broadcastRows``: most rows of a table that is broadcast;
* ``fleetpulse.broadcastBytes``: most bytes, as Parquet, of such a table.
"""

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIMITS = {"rowsPerTask": 4_000_000, "foldRows": 250_000, "broadcastRows": 500_000, "broadcastBytes": 64 << 20}


#: The paths made inside `scratch`, None outside.
_MADE: ContextVar[list | None] = ContextVar("made", default=None)


def limit_of(spark: SparkSession, name: str) -> int:
    return int(spark.conf.get(f"fleetpulse.{name}", str(LIMITS[name])))


def shared_path(spark: SparkSession, name: str) -> str:
    """The path of what outlasts a run, in the folder shared by all executors, ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("fleetpulse.localScratch", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="fleetpulse-")
        spark.conf.set("fleetpulse.localScratch", root)
    return f"{root.rstrip('/')}/fleetpulse/{name}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in that folder."""
    path = shared_path(spark, f"{name}-{uuid.uuid4().hex}")
    if _MADE.get() is not None:
        _MADE.get().append(path)
    return path


def at_path(spark: SparkSession, path: str):
    """The file system that holds `path`, and the path as it takes it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


@contextmanager
def scratch(spark: SparkSession):
    """Intermediate tables written inside are removed at the end, so that no folders pile up where
    the same is done for every batch of a stream."""
    token = _MADE.set([])
    try:
        yield
    finally:
        made = _MADE.get()
        _MADE.reset(token)
        for path in made:
            files, place = at_path(spark, path)
            files.delete(place, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder: a later loss of an executor
    costs a read, not a second computation, and values that depend on the run stay fixed."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(table: DataFrame, rows: int | None = None) -> bool:
    """Whether a `written` table, of `rows` rows if that is known, may be broadcast."""
    spark = table.sparkSession
    sizes = (files.getFileStatus(place).getLen() for files, place in (at_path(spark, f) for f in table.inputFiles()))
    if sum(sizes) > limit_of(spark, "broadcastBytes"):
        return False
    return (table.count() if rows is None else rows) <= limit_of(spark, "broadcastRows")


def lookup_join(rows: DataFrame, table: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join `rows` with a `table` that has few rows per key.

    The table is written once and counted. Within ``broadcastRows`` and ``broadcastBytes`` it is
    broadcast and `rows` are not shuffled. Beyond that both sides are shuffled, and adaptive execution splits hot keys.
    """
    table = written(table, "lookup")
    if few(table):
        table = F.broadcast(table)
    return rows.join(table, on, how)
