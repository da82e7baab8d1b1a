"""Scans of the logical tables. Every reader has a fixed schema; `stream` reads the same as a stream."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.sources import schemas

# Fixed value: how many state documents one task reads.
DOCUMENTS = 1000


def _read(spark: SparkSession, path: str, schema: str, stream: bool, options: dict) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).options(**options).parquet(path)


def read_probe_log(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    return _read(spark, path, schemas.PROBE_LOG, stream, options)


def read_samples(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """Samples as `write_samples` lays them out: a filter on `metric` or `date` skips folders."""
    return _read(spark, path, schemas.METRIC_SAMPLE + ", date date", stream, options)


def read_targets(spark: SparkSession, path: str, prefix: str = "fleet") -> DataFrame:
    """Discovered targets under management, one row per container and network."""
    managed = F.try_element_at("labels", F.lit(f"__meta_docker_container_label_{prefix}_managed"))
    return _read(spark, path, schemas.DISCOVERED_TARGET, False, {}).where(managed == "true")


def read_commands(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    return _read(spark, path, schemas.COMMAND_LOG, stream, options)


def read_command_lines(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """Commands as the plain lines that nodes print, in files under ``cluster=<cluster>/node=<node>/``.

    A line says nothing but itself: node and cluster come from its path, and `ts` is the time the file
    arrived. `seq` is null, as lines of one file have no order in a table."""
    reader = (spark.readStream if stream else spark.read).options(recursiveFileLookup=True, **options)
    lines = reader.text(path)
    place = lambda name: F.regexp_extract(F.col("_metadata.file_path"), f"/{name}=([^/]+)/", 1).alias(name)
    return lines.select(
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("ts"), F.lit(None).cast("bigint").alias("seq"),
        place("node"), place("cluster"), F.col("value").alias("line"),
    )


def read_coordinator_view(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    return _read(spark, path, schemas.COORDINATOR_VIEW, stream, options)


def read_containers(spark: SparkSession, path: str) -> DataFrame:
    """Containers with their label maps; see `operators.topology.nodes` for typed columns."""
    return _read(spark, path, schemas.NODE_LABELS, False, {})


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Inventory rows with the text of each node's own report; see `operators.topology.with_report`."""
    return _read(spark, path, schemas.NODE_SNAPSHOT, False, {})


def read_triggers(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    return _read(spark, path, schemas.TRIGGER_LOG, stream, options)


def read_states(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of ``<cluster>.json`` documents. A document that does not parse is an error."""
    documents = (
        spark.read.schema("state string").option("multiLine", True).option("mode", "FAILFAST")
        .option("pathGlobFilter", "*.json").json(folder)
    )
    # The name is given as in a URL, but for its plus signs.
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    name = F.regexp_extract(name, r"(?s)^(.*)\.json\z", 1)
    # Spark gives a task 32 documents at most, as if each were long; so few rows are not worth a task, nor a file downstream.
    tasks = max(len(documents._jdf.inputFiles()) // DOCUMENTS, spark.sparkContext.defaultParallelism)
    return documents.select(name.alias("cluster"), "state").coalesce(tasks)


def state_clusters(states: DataFrame) -> DataFrame:
    """The clusters that have a stored state."""
    return states.select("cluster").distinct()
