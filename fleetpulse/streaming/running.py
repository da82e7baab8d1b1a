"""How streams run: cadence, state between batches, and where results go.

A step with state takes a batch and the state after the batch before, and returns rows and the
new state. Both are ordinary DataFrames, so a step uses the batch operators as they are, and a
cluster with most of the rows is split as it is there. Rows and state are written per batch, the
state in two places in turn. A batch that is run again, after a crash or the loss of the driver,
reads the same state as before and overwrites only its own rows: each batch counts once.
"""

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fleetpulse.operators.sizing import at_path, scratch

# How often things happen.
CADENCE = {"probe": "200 milliseconds", "refresh": "10 seconds", "scrape": "15 seconds", "discovery": "5 seconds"}

Step = Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame | None]]


def every(writer, cadence: str | None):
    """Trigger at a named cadence; None takes all there is and stops."""
    return writer.trigger(processingTime=CADENCE[cadence]) if cadence else writer.trigger(availableNow=True)


def _state_place(path: str, batch_id: int) -> str:
    return f"{path}/state/place={batch_id % 2}"


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if it does not exist."""
    files, place = at_path(spark, path)
    return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []


def _finish_batch(spark: SparkSession, path: str, batch_id: int) -> None:
    """Say that the state of a batch is whole; a state without rows cannot say so itself."""
    files, place = at_path(spark, f"{path}/done/batch={batch_id}")
    files.mkdirs(place)
    files, place = at_path(spark, f"{path}/done/batch={batch_id - 2}")
    files.delete(place, True)


def _state_before(spark: SparkSession, path: str, batch_id: int, schema: StructType) -> DataFrame:
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    stored = StructType([*schema.fields, StructField("batch", LongType())])
    table = spark.read.schema(stored).parquet(_state_place(path, batch_id - 1))
    return table.where(F.col("batch") == batch_id - 1).drop("batch")


def run_steps(stream: DataFrame, step: Step, path: str, state: str | None = None, cadence: str | None = None):
    """Start running `step` over `stream`; results under `path` (see `results`).

    `state` is the state's schema; without one the step is given None.
    """
    schema = StructType.fromDDL(state) if state else None

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            with scratch(spark):
                before = _state_before(spark, path, batch_id, schema) if schema else None
                rows, after = step(batch, before)
                rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
                if schema:
                    kept = after.select(*schema.fieldNames()).withColumn("batch", F.lit(batch_id).cast("bigint"))
                    kept.write.mode("overwrite").parquet(_state_place(path, batch_id))
            _finish_batch(spark, path, batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{path}/checkpoint")
    return every(writer, cadence).start()


def run_table(table: DataFrame, path: str, cadence: str | None = None):
    """Start keeping a running aggregate; each batch replaces the table under `path` by turns."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
            _state_place(path, batch_id)
        )
        _finish_batch(batch.sparkSession, path, batch_id)

    writer = table.writeStream.outputMode("complete").foreachBatch(on_batch)
    return every(writer.option("checkpointLocation", f"{path}/checkpoint"), cadence).start()


def run_append(rows: DataFrame, path: str, cadence: str | None = None):
    """Start appending final rows to a table under `path`."""
    writer = rows.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows")
    return every(writer.option("checkpointLocation", f"{path}/checkpoint"), cadence).start()


def results(spark: SparkSession, path: str) -> DataFrame:
    """All rows that steps or appends have written."""
    return spark.read.parquet(f"{path}/rows")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table or state after the last batch."""
    last = max(int(name.split("=")[1]) for name in folders(spark, f"{path}/done"))
    return spark.read.parquet(_state_place(path, last)).where(F.col("batch") == last).drop("batch")


def ticks(query) -> list[dict]:
    """The batches of a running query that took rows, as it reports them: number, start, rows."""
    told = [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]
    return [{"batch": p["batchId"], "at": p["timestamp"], "rows": p["numInputRows"]} for p in told if p["numInputRows"]]
