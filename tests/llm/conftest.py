import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts or (doc_id, text) pairs, with columns whose names clash with the operators' own."""

    def make(rows):
        pairs = [r if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, None, "s", None) for i, t in pairs], SCHEMA)

    return make


@pytest.fixture(scope="session")
def clash(make_docs):
    """The same, with more columns named like those the operators add."""
    from pyspark.sql import functions as F

    def make(rows):
        names = ["n_words", "kept", "keep_id", "spans", "matches", "_norm", "_id", "_m", "_s", "_text", "ids", "start", "score", "bits", "node", "w", "count", "rate"]
        return make_docs(rows).select("*", *[F.lit(7).alias(n) for n in names])

    return make
