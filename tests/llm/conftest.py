import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """A table of documents from (doc_id, text) pairs, with columns that clash with results."""

    def make(rows, extra=True):
        df = spark.createDataFrame(list(rows), "doc_id long, text string")
        return df.selectExpr("*", "'x' AS lang", "'s' AS source", "length(text) AS n_chars", "7 AS n_tokens", "'y' AS kept", "0 AS score", "'z' AS unit") if extra else df

    return make


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}
