"""What the operators share: reading tables, batches for Python tasks, intermediate tables.

Python tasks get Arrow batches whose number of rows is bounded (`BATCH_ROWS`, unless the session
sets its own), so that a batch of long texts stays small.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.operators.sizing import scratch_path, written  # noqa: F401

BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """`doc_id` as a long and `text` with null as the empty text, whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(BATCH_ROWS))


def mapped(df: DataFrame, each, schema: str) -> DataFrame:
    """`each` gives for a batch, as a dict of lists, the columns of the result; the batch's rows
    may become any number of rows."""
    small_batches(df.sparkSession)
    spark_schema = _schema(schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(spark_schema)
        for batch in batches:
            if batch.num_rows:
                out = each({n: c for n, c in zip(batch.schema.names, batch.columns)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type, from_pandas=False) for f in arrow], schema=arrow
                )

    return df.mapInArrow(run, spark_schema)


def _schema(text: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(text)


def bounded_sample(rows: DataFrame, most: int, *key: str) -> DataFrame:
    """At most `most` rows, chosen by the hash of `key`: the same ones on every run, whatever the
    order or the number of partitions."""
    return rows.orderBy(F.xxhash64(*key), *key).limit(most)


def hex_digest(column: Column) -> Column:
    return F.sha2(column, 256)
