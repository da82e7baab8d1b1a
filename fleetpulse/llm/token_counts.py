"""Token counts with a cache of digests.

The cache is a Parquet table (digest, n_tokens) in one folder per tokenizer version. Normalised
contents are joined to it by digest; one document of each digest that is not there is encoded, and
the new counts are appended. A run after that encodes nothing it has seen, whatever document holds it.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.tables import mapped, table, texts
from fleetpulse.llm.tokens import encoder, public_path, version_of
from fleetpulse.operators.sizing import shared_path

CACHE = "digest BINARY, n_tokens BIGINT"
LIMIT = 512


def cached(spark, path: str) -> DataFrame:
    """The counts stored so far; two runs at once may have stored one twice."""
    try:
        stored = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str, tokenizer: str, normalise=None) -> DataFrame:
    """`doc_id`, `n_bytes`, `n_tokens` and `digest` of every document, in any order.

    `tokenizer` is the path of a `tokenizers` file that all workers have, `cache` a folder that all
    executors share. `normalise` maps the text column to what is digested and encoded; by default
    the text itself, as byte-level tokenizers tell all texts apart.

    Null text counts as empty (0 tokens). Rows with a null or repeated `doc_id` are each counted;
    other columns are ignored; an empty table gives no row and leaves the cache as it is.
    """
    spark = docs.sparkSession
    path = f"{cache.rstrip('/')}/{version_of(tokenizer)}"
    rows = texts(docs)
    content = normalise(F.col("text")) if normalise else F.col("text")
    rows = rows.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), content.alias("content")
    ).withColumn("digest", F.unhex(F.sha2("content", 256)))
    # One document stands for each digest that the cache lacks. Its key holds doc_id as well, so that
    # a text of a third of all rows is not sent to one task.
    missing = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(cached(spark, path), "digest", "left_anti")
    picked = rows.alias("r").join(
        missing.hint("shuffle_hash").alias("m"),
        (F.col("r.digest") == F.col("m.digest")) & F.col("r.doc_id").eqNullSafe(F.col("m.doc_id")),
        "left_semi",
    )

    def encode(batch):
        counts = encoder(tokenizer, True).encode_all(batch["content"].to_pylist())
        return {"digest": batch["digest"], "n_tokens": list(counts)}

    encoded = mapped(picked.select("digest", "content"), encode, CACHE).dropDuplicates(["digest"])
    encoded.write.mode("append").parquet(path)
    return rows.drop("content").join(cached(spark, path), "digest", "left").select(
        "doc_id", "n_bytes", "n_tokens", "digest"
    )


def op1_token_counts(spark, folder: str) -> DataFrame:
    """The cache is one folder for all runs that share `spark.checkpoint.dir`."""
    counts = count_tokens(
        table(spark, folder, "documents"), shared_path(spark, "token-cache"), public_path("byte_bpe_50k.json")
    )
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
