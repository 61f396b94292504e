import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # columns that a user's table may have and the operators must not trip over
        T.StructField("kept", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("tokens", T.StringType()),
        T.StructField("shard", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """Documents from (doc_id, text[, lang[, source]]), with clashing extra columns."""
        full = []
        for row in rows:
            doc_id, text, lang, source = (*row, None, None)[:4]
            full.append((doc_id, text, lang, source, len(text or ""), "k", "d", "x", "t", "s"))
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def ready(spark):
    from attestlake.llm import common

    common.batch_settings(spark)
    return spark


@pytest.fixture(scope="session")
def real_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
