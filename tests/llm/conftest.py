import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs, with columns of other names and types beside them."""

    def make(rows, extra=True):
        schema = "doc_id BIGINT, text STRING" + (", fp STRING, n_words STRING, kept STRING, score STRING" if extra else "")
        rows = [(*r, "x", None, "y", "z") if extra else tuple(r) for r in rows]
        return spark.createDataFrame(rows, T.StructType.fromDDL(schema))

    return make


#: Nulls, empty and blank texts, repeated rows, a repeated id, texts without letters.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (None, "a word"), (None, None), (5, "same text here"), (5, "same text here"),
    (6, "one"), (6, "another"), (7, "ÀÉ ünïcode 漢字   x́ \x1c\x85 end"), (8, "!!! ### $$$"), (9, "x" * 5000),
]
