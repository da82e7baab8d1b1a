"""From documents to packed training sequences: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of `documents`. What a
stage drops or changes is gone for those after it.
"""

from pyspark.sql import DataFrame, SparkSession

from fleetpulse.llm import decontamination, packing, private_data, quality, simhash
from fleetpulse.llm.tables import table, written
from fleetpulse.llm.tokens import public_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is test items."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def private_data_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind's name in place of personal data."""
    return private_data.redact(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs, public_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("near deduplication", near_deduplication),
    ("benchmark decontamination", benchmark_decontamination),
    ("private data", private_data_redaction),
    ("packing", sequence_packing),
]
#: SQL can express neither the trained models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
