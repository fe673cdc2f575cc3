import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names an operator might use itself."""
    def make(pairs, extra=True):
        df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in pairs], DOCS)
        if extra:
            for c in ("_id", "_q", "id", "node", "n_words", "kept", "spans", "score", "hits", "rank", "n_tokens"):
                df = df.withColumn(c, F.lit("x"))
        return df

    return make
