"""Running counts by step of time, for streams that run for months.

The table is cut by ranges of time. A batch writes what it adds to the steps it touches, one folder per
range and batch, and nothing else; no count is kept in the stream's own state. A range that lies
behind the watermark (the newest step seen, less `lateness`) is put together: its sum is written as
one folder, which stands for all of the range up to that batch, and what it stands for is deleted a
batch later, when it is sure to be there. A row that comes after that opens its range again, to be
added to the stored sum by the same rule, however late it is.

    open/span=<range>/batch=<batch>     what a batch has added
    closed/span=<range>/upto=<batch>    the sum of all batches up to that one

A batch that is run again replaces its own folders, and reads the same ones as before. Per batch only
the folders of open ranges are listed, so its work depends on `lateness`, not on the past.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.operators import rates
from fleetpulse.operators.sizing import at_path
from fleetpulse.streaming import running


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(name.split("=")[1]) for name in running.folders(spark, path) if "=" in name)


def _delete(spark: SparkSession, path: str) -> None:
    files, place = at_path(spark, path)
    files.delete(place, True)


def _clear(spark: SparkSession, path: str, batch_id: int) -> None:
    """Delete what sums of earlier batches stand for."""
    for span in _numbers(spark, f"{path}/open"):
        sums = [b for b in _numbers(spark, f"{path}/closed/span={span}") if b < batch_id]
        if not sums:
            continue
        for old in sums[:-1]:
            _delete(spark, f"{path}/closed/span={span}/upto={old}")
        added = _numbers(spark, f"{path}/open/span={span}")
        for old in (b for b in added if b <= sums[-1]):
            _delete(spark, f"{path}/open/span={span}/batch={old}")
        if all(b <= sums[-1] for b in added):
            _delete(spark, f"{path}/open/span={span}")


def _close(spark: SparkSession, path: str, batch_id: int, schema: str, behind: int) -> None:
    """Put the open ranges that lie behind together, as of this batch."""
    spans = _numbers(spark, f"{path}/open")
    places = []
    for span in (s for s in spans if spans[-1] - s >= behind):
        sums = [b for b in _numbers(spark, f"{path}/closed/span={span}") if b < batch_id]
        added = [b for b in _numbers(spark, f"{path}/open/span={span}") if (sums[-1] if sums else -1) < b <= batch_id]
        if added:
            places += [f"{path}/open/span={span}/batch={b}" for b in added]
            places += [f"{path}/closed/span={span}/upto={b}" for b in sums[-1:]]
    if not places:
        return
    # What rows hold is enough: the range is in the rows as well as in the folder's name.
    rows = spark.read.schema(f"{schema}, part bigint").parquet(*places)
    keys = [c for c in rows.columns if c != "ops"]
    whole = rows.groupBy(*keys).agg(F.sum("ops").alias("ops"))
    whole = whole.withColumns({"span": F.col("part"), "upto": F.lit(batch_id).cast("bigint")})
    whole.repartition("span").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("span", "upto").parquet(f"{path}/closed")


def run_counts(
    log: DataFrame, keys: list, path: str, step: str = "15s", span: str = "1h", lateness: str = "10m",
    cadence: str | None = None,
):
    """Start counting operations per step of `log`, a stream, under `path`.

    Rows without a time belong to no step and are not counted. `span` must be a multiple of `step`.
    """
    if rates.micros(span) % rates.micros(step):
        raise ValueError("span must be a multiple of step")
    steps_of = rates.micros(span) // rates.micros(step)
    behind = -(-rates.micros(lateness) // rates.micros(span)) + 1
    given = rates.ops_per_step(log, keys, step).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _clear(spark, path, batch_id)
        counts = rates.ops_per_step(batch.where(F.col("ts").isNotNull()), keys, step)
        part = F.floor(F.col("first") / steps_of)
        counts = counts.withColumns({"part": part, "span": part, "batch": F.lit(batch_id).cast("bigint")})
        counts.repartition("span").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("span", "batch").parquet(f"{path}/open")
        _close(spark, path, batch_id, schema, behind)

    writer = log.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{path}/checkpoint")
    return running.every(writer, cadence).start()


def counts_now(spark: SparkSession, path: str, since: str | None = None, span: str = "1h") -> DataFrame:
    """Operations per step of all batches so far; with `since`, a time, of the ranges from its own on.

    Folders that a newer sum stands for, and are not deleted yet, do not count twice.
    """
    parts = []
    for kind, number in (("open", "batch"), ("closed", "upto")):
        if _numbers(spark, f"{path}/{kind}"):
            rows = spark.read.parquet(f"{path}/{kind}").withColumnRenamed(number, "number")
            parts.append(rows.drop("part").withColumn("whole", F.lit(kind == "closed")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if since is not None:
        at = F.unix_micros(F.lit(since).cast("timestamp_ntz").cast("timestamp"))
        rows = rows.where(F.col("span") >= F.floor(at / rates.micros(span)))
    last = rows.where("whole").groupBy("span").agg(F.max("number").alias("upto"))
    rows = rows.join(last, "span", "left")
    valid = F.when(F.col("whole"), F.col("number") == F.col("upto")).otherwise(F.col("upto").isNull() | (F.col("number") > F.col("upto")))
    keys = [c for c in rows.columns if c not in ("span", "number", "whole", "upto", "ops")]
    return rows.where(valid).groupBy(*keys).agg(F.sum("ops").alias("ops"))
