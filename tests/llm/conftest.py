import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents rows from (doc_id, text[, lang[, source]]), with extra columns
    whose names clash with those that the operators add."""
    def make(rows, clash=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            for c in ("key", "node", "n_bytes", "size", "bucket", "of", "score", "ref", "hash", "bands", "target"):
                from pyspark.sql import functions as F
                df = df.withColumn(c, F.lit("clash"))
        return df
    return make
