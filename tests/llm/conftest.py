import pytest


@pytest.fixture
def table(spark):
    """Documents of given texts, with the columns of the real table."""

    def make(texts, ids=None):
        rows = [(i if ids is None else ids[i], t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make
