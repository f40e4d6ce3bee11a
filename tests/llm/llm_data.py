"""Fixtures of the training-data tests: small documents with odd rows."""

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])

SF_SMALL = "/root/testdata/sf0.001"

LONG = "alpha beta gamma delta " * 5000


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang) rows."""
    def make(rows, **extra):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(3)
        from pyspark.sql import functions as F
        for name, value in extra.items():
            df = df.withColumn(name, F.lit(value))
        return df
    return make


#: Nulls, empty and blank texts, repeats, ties, a very long text, odd letters.
ODD = [(5, "The quick brown fox jumps over the lazy dog by the river", "en"), (None, None, "en"), (7, "", None),
       (7, "", None), (3, None, "fr"), (9, " \t\n ", "en"), (None, "no id at all", "en"), (11, LONG, "en"),
       (5, "The quick brown fox jumps over the lazy dog by the river", "en"), (-4, "ÉCOLE été ǅ 漢字 \U0001F600 x", "fr"),
       (2 ** 40, "one", "en"), (12, "12345 --- !!!", None), (5, "same id, other text", "en"), (13, LONG + "end", "de")]


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    return make_docs(ODD)
