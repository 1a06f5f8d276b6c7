import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                         T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def docs_of(spark):
    """A documents frame of (doc_id, text) pairs, by default with columns whose names helpers might use."""

    def make(pairs, extra=True):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs], DOCUMENT)
        if extra:
            for name in ("key", "pos", "value", "digest", "comp", "runs", "kind", "score", "ids", "node", "a"):
                df = df.selectExpr("*", f"'{name}' AS {name}")
        return df

    return make

