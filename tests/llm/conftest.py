import pytest

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang) tuples."""

    def make(*rows):
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, None, None) for r in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Null ids and texts, empty and white texts, repeated rows, one very long text, a lone endless word."""
    return make_docs((None, "no id at all here my friend"), (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (5, "word " * 60_000), (6, "x" * 200_000), (7, "é▁ ￿ 日本 \r\n\x00 end"))
