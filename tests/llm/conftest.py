import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs."""
    def make(pairs):
        return spark.createDataFrame(
            [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in pairs], DOCS)
    return make


@pytest.fixture
def some_words():
    def words(seed, n, vocabulary=4000):
        pick = random.Random(seed)
        return [f"w{pick.randrange(vocabulary)}" for _ in range(n)]
    return words
