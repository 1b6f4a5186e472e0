import pytest

#: Schema of documents with columns whose names the operators use themselves.
DOCS = "doc_id long, text string, n_words long, row string, hits string, spans string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds documents from (id, text) pairs, with clashing extra columns."""

    def make(pairs):
        return spark.createDataFrame([(i, t, 7, "r", "h", "s", None if t is None else len(t)) for i, t in pairs], DOCS)

    return make
