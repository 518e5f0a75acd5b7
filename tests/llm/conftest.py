import pytest
from pyspark.sql import types as T

DOC = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents from (doc_id, text, lang, source) tuples; missing ends are null."""

    def make(rows):
        return spark.createDataFrame([(*r, *(None,) * (5 - len(r))) for r in rows], DOC)

    return make


@pytest.fixture(scope="session")
def prose(spark, small):
    """The driver's small documents as (doc_id, text, lang, source)."""
    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source")
    return [tuple(r) for r in df.collect()]
