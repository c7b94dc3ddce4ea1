import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("hits", T.StringType()), T.StructField("fp", T.StringType())])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def make(spark):
    """Documents with columns whose names the operators use themselves."""

    def build(rows):
        full = [(r[0], r[1], *(r[2:4] if len(r) > 3 else (None, None)), None, "x", 0.5, "y", "z") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in every column, empty and very long texts, ties and rows that repeat."""
    long_ = " ".join(f"wort{i % 977} und{i}" for i in range(40_000))
    return make([(1, None, "en", "a"), (2, "", "en", "a"), (3, "  \n\t ", None, None), (4, long_, "de", "a"), (5, long_, "de", None), (5, long_, "de", None), (None, "Same text here", "en", "b"), (None, "Same text here", "en", "b"), (6, "same  TEXT here", "en", "b"), (7, "Ünïcode — dash… 語 \U0001f600 '99 it's", "fr", "c"), (8, "1234 5678", "en", "c"), (8, "other text with the same id", "en", "c"), (9, "a" * 5000, "en", "c")])


@pytest.fixture(scope="session")
def nothing(make):
    return make([])
